"""Readers and writers: CSV applications, JSON catalogues, JSON lines, repaired model replies, append-only tables."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

APPLICATION_CSV = "application_id string, brand_name string, class_type string, alcohol_content string, net_contents string, producer_name string, producer_address string, country_of_origin string, importer_name string, importer_address string, beverage_type string, has_sulfites_declaration string, images string"


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    """Applications CSV; quoted values may hold line breaks, empty values are null, `images` becomes an array."""
    df = spark.read.csv(path, schema=APPLICATION_CSV, header=True, multiLine=True, escape='"')
    return df.withColumn("has_sulfites_declaration", F.lower("has_sulfites_declaration") == "true").withColumn("images", F.filter(F.split("images", ";"), lambda x: F.trim(x) != ""))


def read_catalog(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; broken lines end up in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").json(path, columnNameOfCorruptRecord="_corrupt")


def repair_json(text: str | None) -> str | None:
    """A model reply as valid JSON: without code fence, brackets balanced, or pairs picked out singly; null if nothing is left."""
    if not text:
        return None
    s = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    for candidate in (s, _closed(s)):
        try:
            return json.dumps(json.loads(candidate))
        except ValueError:
            continue
    pairs = re.findall(r'"(\w+)"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|true|false|null)', s)
    return json.dumps({k: json.loads(v) for k, v in pairs}) if pairs else None


def _closed(s: str) -> str:
    """`s` with an open string and all open brackets closed."""
    stack, quoted, skip = [], False, False
    for ch in s:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    return re.sub(r",\s*$", "", s + '"' * quoted) + "".join(reversed(stack))


@F.pandas_udf(T.StringType())
def repair_json_udf(x: pd.Series) -> pd.Series:
    return x.map(repair_json)


def reply_fields(df: DataFrame, reply: str) -> DataFrame:
    """Add `fields`, map<name, struct<value, conf>> of a reply: objects with value and conf, or bare values of conf 'high'.

    Only replies that don't parse natively pass through the repair.
    """
    parses = F.try_parse_json(F.col(reply)).isNotNull()
    whole = df.where(F.coalesce(parses, F.lit(False))).withColumn("__json", F.col(reply))
    broken = df.where(~F.coalesce(parses, F.lit(False))).withColumn("__json", repair_json_udf(F.col(reply)))
    entries = F.from_json("__json", "map<string,string>")
    field = lambda v: F.when(
        v.startswith("{"), F.struct(F.get_json_object(v, "$.value").alias("value"), F.coalesce(F.get_json_object(v, "$.conf"), F.lit("high")).alias("conf"))
    ).otherwise(F.struct(v.alias("value"), F.lit("high").alias("conf")))
    return whole.unionByName(broken).withColumn("fields", F.transform_values(entries, lambda _, v: field(v))).drop("__json")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append events; states are read as the latest event of a key (`plans.history.latest`), nothing is updated in place."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files may lack columns that were added later."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def quarantine(df: DataFrame, checks: dict[str, F.Column]) -> DataFrame:
    """Add `reason`: the first check a row fails, null for a good row. Unknown (null) counts as failed."""
    reason = None
    for name, ok in checks.items():
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return df.withColumn("reason", reason if reason is not None else F.lit(None).cast("string"))
