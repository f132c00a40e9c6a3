"""Train/test split, accuracy and the classification report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split(df: DataFrame, key: str = "customerid", test: int = 20, seed: int = 0) -> DataFrame:
    """Add ``is_test``, true for about ``test`` percent of the keys.

    The digest of the key decides, so the split does not change with the layout of
    the data, which ``randomSplit`` depends on, and needs no shuffle.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") % 100
    return df.withColumn("is_test", bucket < test)


def class_balance(df: DataFrame, label: str = "ltv_cluster") -> DataFrame:
    """Share of each class; the window runs over one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label, (F.col("n") / total).alias("share"))


def accuracy(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = F.col(label).cast("double") == F.col(prediction).cast("double")
    return pairs.agg(F.avg(hit.cast("double")).alias("accuracy"))


def classification_report(
    pairs: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means.

    The pairs are read and shuffled once, down to one row per (label, prediction); all
    else is arithmetic on those. What is undefined counts as 0.
    """
    cells = pairs.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("n"))
    n, none = F.col("n"), F.lit(0).cast("bigint")
    hits = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)
    sides = F.array(
        _side(F.col("label"), actual=n, predicted=none, hits=hits),
        _side(F.col("prediction"), actual=none, predicted=n, hits=none),
    )
    classes = (
        cells.select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
        .withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("actual")))
        .withColumn(
            "f1",
            _ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
    )
    # Every line is a weighted mean over classes: of one class, of all alike, or of all
    # by their size. Accuracy is the mean recall by size.
    scores = [F.col(c) for c in ("precision", "recall", "f1")]
    even, size = F.lit(1).cast("bigint"), F.col("actual")
    lines = F.array(
        _line(F.col("class").cast("string"), even, scores),
        _line(F.lit("accuracy"), size, [F.col("recall")] * 3),
        _line(F.lit("macro avg"), even, scores),
        _line(F.lit("weighted avg"), size, scores),
    )
    return (
        classes.select(F.inline(lines))
        .groupBy("row")
        .agg(
            *[
                _ratio(F.sum(F.col(c) * F.col("weight")), F.sum("weight")).alias(c)
                for c in ("precision", "recall", "f1")
            ],
            F.sum("support").alias("support"),
        )
    )


def _side(of: Column, **counts: Column) -> Column:
    return F.struct(of.alias("class"), *[c.alias(name) for name, c in counts.items()])


def _line(row: Column, weight: Column, scores: list[Column]) -> Column:
    named = [c.alias(name) for c, name in zip(scores, ("precision", "recall", "f1"))]
    support = F.col("actual").alias("support")
    return F.struct(row.alias("row"), weight.alias("weight"), *named, support)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
