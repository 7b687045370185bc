"""Read side: paged history, batches, reviewer events with the latest state winning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, by aggregation: a hot key is reduced before the shuffle.

    Rows with a null key form a group of their own; among rows equal in all of `order` any may win, so end it
    with a unique column.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return best.select(*keys, "__last.*")


def filings(applications: DataFrame) -> DataFrame:
    """The latest filing of each session: filings are received again under new rows."""
    return latest(applications.where("session_id is not null"), ["session_id"], ["submitted_at", "row_id"])


def history(sessions: DataFrame, applications: DataFrame, status: str | None = None, beverage_type: str | None = None, brand: str | None = None) -> DataFrame:
    """Sessions with brand and class of their filing. Filters that are null or empty are absent; the brand is a
    substring without regard to case, in which % and _ are ordinary characters."""
    joined = sessions.join(filings(applications).select("session_id", "brand_name", "class_type"), "session_id", "left")
    wanted: list[Column] = [F.col(c) == v for c, v in (("status", status), ("beverage_type", beverage_type)) if v]
    if brand:
        wanted.append(F.lower("brand_name").contains(brand.lower()))
    tokens = F.coalesce("total_input_tokens", F.lit(0)) + F.coalesce("total_output_tokens", F.lit(0))
    shown = joined.select("session_id", "brand_name", "class_type", "beverage_type", "status", "overall_confidence", "created_at", tokens.alias("total_tokens"))
    return shown.where(reduce(lambda a, b: a & b, wanted)) if wanted else shown


def page(df: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page, newest first; the id breaks ties, so pages never overlap."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    return df.orderBy(F.col("created_at").desc_nulls_last(), "session_id").offset((number - 1) * size).limit(size)


def pages(total: Column, size: int = 20) -> Column:
    """Pages that so many rows fill."""
    return F.ceil(total / size)


def by_position(x: Column, order: list[str], unknown: int = 999) -> Column:
    """Place of a value in a list, from 1, to sort by; values that aren't in it come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), x), F.lit(0)), F.lit(unknown))


def final_status(total: Column, failed: Column) -> Column:
    """A batch has failed if all of its items have."""
    return F.when(total == failed, "failed").otherwise("completed")


def merged(*maps: Column) -> Column:
    """One map of several; later ones win, null maps add nothing."""
    entries = F.flatten(F.filter(F.array(*map(F.map_entries, maps)), lambda m: m.isNotNull()))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def batch_progress(batches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counters derived from the sessions beside the stored ones that drift from them."""
    done = F.col("status").isin("pass", "needs_review", "fail")
    seen = sessions.where("batch_id is not null").groupBy("batch_id").agg(F.count("*").alias("sessions"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "fail").alias("failed"))
    joined = batches.join(seen, "batch_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "batch_id",
        zero("sessions").alias("sessions"),
        zero("done").alias("done"),
        zero("failed").alias("failed"),
        F.coalesce(F.floor(F.try_divide(F.lit(100.0) * zero("done"), F.col("total_items")) + 0.5), F.lit(0)).alias("percent"),
        (zero("done") - F.coalesce("completed_items", F.lit(0))).alias("drift"),
    )


def effective_results(results: DataFrame) -> DataFrame:
    """The latest result of each session and field with the status that counts: an override before the finding."""
    last = latest(results, ["session_id", "field_name"], ["compared_at", "result_id"])
    return last.withColumn("effective_status", F.coalesce(F.nullif("override_status", F.lit("")), "status"))


def review_summary(results: DataFrame) -> DataFrame:
    """Fields, flagged and reviewed fields of each session, and the names of the flagged in order."""
    fields = effective_results(results)
    flagged = F.col("status") != "match"
    return fields.groupBy("session_id").agg(
        F.count("*").alias("total_fields"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(F.coalesce("reviewed", F.lit(False)) | F.col("override_status").isNotNull()).alias("reviewed"),
        F.array_join(F.array_sort(F.collect_set(F.when(flagged, F.col("field_name")))), ",").alias("flagged_names"),
    )


def weighted_confidence(results: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean confidence of each session's latest fields by weight; fields without a weight count once, no weight at all gives 0."""
    w = F.coalesce("weight", F.lit(1.0))
    scored = effective_results(results).join(F.broadcast(weights), "field_name", "left").where("confidence is not null")
    return scored.groupBy("session_id").agg(F.coalesce(F.try_divide(F.sum(F.col("confidence") * w), F.sum(w)), F.lit(0.0)).alias("confidence"))
