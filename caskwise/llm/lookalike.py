"""Visually identical text with different characters (problem 2).

Every value is mapped to its look-alike form, the forms are grouped in SQL under the accent-sensitive
and case-sensitive Unicode collation, the smallest member by length and code points stands for
its class, and the class's member is joined back to the values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caskwise.functions.chars import consistent

#: Values of printable ASCII and line breaks are in the consistent form already.
PLAIN = r"^[\x20-\x7e\n\r]*$"


@F.pandas_udf(T.StringType())
def consistent_udf(values: pd.Series) -> pd.Series:
    return values.map(consistent, na_action="ignore")


def canonical_values(spark: SparkSession, values: DataFrame, column: str = "value") -> DataFrame:
    """(value, canonical) for every distinct value of `column` that is not plain ASCII.

    Null values have no form and are left out, as are plain ASCII values (the empty text among them), which
    stand for themselves. Repeated values come once; an empty table gives an empty table.
    """
    distinct = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull() & ~F.col("value").rlike(PLAIN)).distinct()
    mapped = distinct.withColumn("mapped", consistent_udf("value"))
    return spark.sql(
        """
        with classes as (
            select mapped collate UNICODE as class, min_by(mapped, struct(char_length(mapped), mapped)) as canonical
            from {mapped} group by mapped collate UNICODE)
        select m.value, c.canonical
        from {mapped} m join classes c on m.mapped collate UNICODE = c.class
        """,
        mapped=mapped,
    )


def with_consistent(spark: SparkSession, df: DataFrame, column: str, out: str) -> DataFrame:
    """Add `out`: `column` in the consistent form. Rows and other columns stay; null stays null.

    Only rows whose value is not plain take part in the join, so a hot plain value is never shuffled.
    """
    plain = F.col(column).isNull() | F.col(column).rlike(PLAIN)
    forms = canonical_values(spark, df, column).select(F.col("value").alias("__value"), F.col("canonical").alias(out))
    odd = df.where(~plain)
    return df.where(plain).withColumn(out, F.col(column)).unionByName(odd.join(forms, odd[column] == forms["__value"], "left").drop("__value"))


def inconsistent(spark: SparkSession, results: DataFrame) -> DataFrame:
    """(result_id, side): the declared or extracted values that are not in the consistent form.

    Null and empty values are in it; a repeated row is reported under each of its ids.
    """
    long = results.select(
        F.col("result_id").cast("bigint").alias("result_id"), F.expr("stack(2, 'declared', declared_value, 'extracted', extracted_value) as (side, value)")
    ).where(~F.coalesce(F.col("value"), F.lit("")).rlike(PLAIN))
    forms = canonical_values(spark, long).where("value <> canonical").withColumnRenamed("value", "form_of")
    return long.join(forms, long["value"] == forms["form_of"]).select("result_id", "side")
