"""Append-only store: a session is visible once its commit marker is written; states are latest-wins views over events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caskwise.plans.history import latest
from caskwise.sources.readers import append, read_merged

# Statuses that an override may set, and decisions on a session.
OVERRIDES = ("match", "content_mismatch", "field_missing")
DECISIONS = ("confirmed", "overridden")


class Store:
    """Tables under one path that all executors share. Nothing is updated in place, so a lost job leaves at most rows
    without a marker, which no view shows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def read(self, name: str) -> DataFrame:
        return read_merged(self.spark, self._at(name))

    def events(self, name: str, schema: str) -> DataFrame:
        """Events of a kind; none before the first is written."""
        try:
            return self.read(name)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def add_sessions(self, sessions: DataFrame, applications: DataFrame, results: DataFrame, commit: str) -> None:
        """Three tables, then the marker under `commit`; a repeated commit is shown once, as ids stay the same."""
        for name, df in (("sessions", sessions), ("applications", applications), ("results", results)):
            append(df.withColumn("commit_id", F.lit(commit)), self._at(name))
        append(self.spark.createDataFrame([(commit,)], "commit_id string").withColumn("at", F.current_timestamp()), self._at("commits"))

    def committed(self, name: str) -> DataFrame:
        return self.read(name).join(self.read("commits").select("commit_id").distinct(), "commit_id", "left_semi").drop("commit_id").distinct()

    def add_batch(self, batches: DataFrame, skipped: DataFrame) -> None:
        """Batches (batch_id, total_items, created_at), which begin as 'processing', and the items that were left out with their reasons."""
        append(batches.withColumn("status", F.lit("processing")), self._at("batches"))
        append(skipped, self._at("skipped"))

    def feedback(self, events: DataFrame) -> DataFrame:
        """Append answers (event_id, session_id, ai_correct, field_name, note, at) on known sessions; returns those refused."""
        known = events.join(self.committed("sessions").select("session_id"), "session_id", "left_semi")
        append(known, self._at("feedback"))
        return events.join(known.select("event_id"), "event_id", "left_anti")

    def decide(self, decisions: DataFrame) -> DataFrame:
        """Append decisions (event_id, session_id, decision, notes, at); returns those refused: unknown session or decision."""
        known = decisions.join(self.committed("sessions").select("session_id"), "session_id", "left_semi").where(F.col("decision").isin(*DECISIONS))
        append(known, self._at("decisions"))
        return decisions.join(known.select("event_id"), "event_id", "left_anti")

    def override(self, events: DataFrame) -> DataFrame:
        """Append overrides (event_id, session_id, field_name, override_status, override_note, at); returns those refused."""
        fields = self.committed("results").select("session_id", "field_name").distinct()
        known = events.join(fields, ["session_id", "field_name"], "left_semi").where(F.col("override_status").isNull() | F.col("override_status").isin(*OVERRIDES))
        append(known, self._at("overrides"))
        return events.join(known.select("event_id"), "event_id", "left_anti")

    def sessions(self) -> DataFrame:
        """Sessions with their latest decision; status and score never change by it."""
        last = latest(self.events("decisions", "event_id string, session_id string, decision string, notes string, at timestamp"), ["session_id"], ["at", "event_id"]).select("session_id", F.col("decision").alias("agent_decision"), F.col("notes").alias("agent_notes"))
        return self.committed("sessions").join(last, "session_id", "left")

    def results(self) -> DataFrame:
        """Results with their latest override and the status that counts; an override marks a field as reviewed."""
        last = latest(self.events("overrides", "event_id string, session_id string, field_name string, override_status string, override_note string, at timestamp"), ["session_id", "field_name"], ["at", "event_id"]).select("session_id", "field_name", "override_status", "override_note", F.lit(True).alias("__seen"))
        joined = self.committed("results").join(last, ["session_id", "field_name"], "left")
        return joined.withColumn("reviewed", F.coalesce("__seen", F.lit(False))).withColumn("effective_status", F.coalesce("override_status", "status")).drop("__seen")


def uncached(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no cached result; keys that are null are never cached."""
    return df.join(cache.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def with_cached(df: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Add the cached `value` of each key, null where there is none; repeated cache rows count once."""
    return df.join(cache.groupBy(key).agg(F.max(value).alias(value)), key, "left")


def reviewed_ratio(results: DataFrame) -> DataFrame:
    """Share of flagged fields that are reviewed, whether all are, and the next one to review, for each session."""
    flagged = F.col("status") != "match"
    open_ = flagged & ~F.coalesce("reviewed", F.lit(False))
    return results.groupBy("session_id").agg(
        F.coalesce(F.try_divide(F.count_if(flagged & F.col("reviewed")) * F.lit(1.0), F.count_if(flagged)), F.lit(1.0)).alias("ratio"), (F.count_if(open_) == 0).alias("done"), F.min(F.when(open_, F.col("field_name"))).alias("next")
    )
