"""Queries of the llm operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caskwise.llm.addresses import same_location
from caskwise.llm.leakage import leaked_items
from caskwise.llm.lexicon import mapped_classes
from caskwise.llm.lookalike import inconsistent
from caskwise.llm.mixing import drawn, mixed, sharded, shares
from caskwise.llm.names import same_names
from caskwise.llm.spam import spam_pages
from caskwise.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


P2_SQL = r"""
with v as (
    select result_id, 'declared' as side, declared_value as value from comparison_results
    union all select result_id, 'extracted', extracted_value from comparison_results),
w as (
    select result_id, side, value, regexp_extract_all(value, '[\p{L}\p{M}\p{N}]+(?:[''’.&-][\p{L}\p{M}\p{N}]+)*') as words
    from v where value is not null and not regexp_full_match(value, '[\x20-\x7e\n\r]*'))
select result_id, side from w
where nfc_normalize(value) <> value
   or regexp_matches(value, '[\x{ff01}-\x{ff5e}\x{ff61}-\x{ff9f}\x{ffe0}-\x{ffee}\x{fb00}-\x{fb06}\x{1d400}-\x{1d7ff}]')
   or regexp_matches(value, '[\t\x{a0}\x{1680}\x{2000}-\x{200f}\x{202a}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{ad}\x{34f}\x{61c}\x{180e}\x{feff}\x{fe00}-\x{fe0f}]')
   or len(list_filter(words, lambda x: regexp_matches(x, '\p{Latin}') and regexp_matches(x, '[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]'))) > 0
"""


@query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return inconsistent(spark, table(spark, d, "comparison_results"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    sources = {name: table(spark, d, name) for name in ("applications", "test_applications")}
    return mapped_classes(spark, sources, table(spark, d, "class_reference"))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return same_location(table(spark, d, "applications"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return same_names(table(spark, d, "applications"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p7_mix")
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return drawn(spark, _mix(spark, d)).drop("rank", "in_pass")


def _mix(spark: SparkSession, d: str) -> DataFrame:
    return mixed(spark, table(spark, d, "documents"), table(spark, d, "source_weights"))


@query("p7_shares")
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(spark, _mix(spark, d), table(spark, d, "source_weights"))


@query("p7_shards")
def p7_shards(spark: SparkSession, d: str) -> DataFrame:
    return sharded(spark, _mix(spark, d))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents"))
