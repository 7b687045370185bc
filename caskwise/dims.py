"""Small lookup tables, as DataFrames of fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# How much a field counts in the overall confidence.
WEIGHTS = {
    "government_warning": 2.0, "brand_name": 1.5, "class_type": 1.5, "alcohol_content": 1.5, "net_contents": 1.0, "producer_name": 1.0,
    "producer_address": 0.5, "country_of_origin": 0.8, "importer_name": 0.8, "importer_address": 0.5, "sulfites_declaration": 0.5,
}


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "field_name string, weight double")


def weights_sql() -> str:
    return "(values " + ", ".join(f"('{f}', {w}::double)" for f, w in WEIGHTS.items()) + ") as w(field_name, weight)"
