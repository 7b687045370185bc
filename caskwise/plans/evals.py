"""Evaluation: accuracy, confusion, differences between two versions, stratified subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, expected: str, actual: str) -> DataFrame:
    return df.groupBy(F.coalesce(expected, F.lit("none")).alias("expected"), F.coalesce(actual, F.lit("none")).alias("actual")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, by: str, correct: str) -> DataFrame:
    """Rows, right rows and their ratio for each value of `by`; rows without a judgement don't count."""
    judged = df.where(F.col(correct).isNotNull())
    return judged.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col(correct)).alias("correct"), F.coalesce(F.try_divide(F.count_if(F.col(correct)) * F.lit(1.0), F.count("*")), F.lit(0.0)).alias("accuracy"))


def long_form(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name, value), one row for each column; every struct has the same field names."""
    return df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns))).alias("f")).select(key, "f.*")


def differences(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name, old_value, new_value) wherever two versions differ, or only one has the key; null equals null."""
    a = long_form(old, key, columns).withColumnRenamed("value", "old_value")
    b = long_form(new, key, columns).withColumnRenamed("value", "new_value")
    return a.join(b, [key, "field_name"], "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by `order`, by aggregation instead of a sorted group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__first")).select(key, "__first.*")


def stratified(df: DataFrame, group: str, order: str, few: int = 3) -> DataFrame:
    """One row of a small group (up to `few`), two of a larger, first by `order`.

    Two smallest values and the size of a group come from partial aggregates, so no group is sorted as a whole.
    """
    first = df.groupBy(group).agg(F.min(order).alias("__a"), F.count("*").alias("__n")).withColumnRenamed(group, "__group")
    later = df.select(group, order).join(first, F.equal_null(F.col(group), F.col("__group"))).where((F.col(order) > F.col("__a")) & (F.col("__n") > few))
    second = later.groupBy("__group").agg(F.min(order).alias("__b"))
    keys = first.select(F.col("__group"), F.col("__a").alias("__key")).union(second.select("__group", F.col("__b")))
    return df.join(keys, F.equal_null(F.col(group), F.col("__group")) & (F.col(order) == F.col("__key")), "left_semi")


def ranked(df: DataFrame, group: str, order: str) -> DataFrame:
    """Position of each row in its group, from 1; for groups that are known to be small (panels of a label)."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(order)))
