"""Queries over the core operators, each with its equivalent SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caskwise.dims import weights, weights_sql
from caskwise.functions import classes as C
from caskwise.functions import kernels as K
from caskwise.functions import text as X
from caskwise.operators import matchers as M
from caskwise.operators.units import stated_quantities
from caskwise.plans.evals import accuracy, confusion, differences, first_rows, long_form, stratified
from caskwise.plans.history import batch_progress, by_position, final_status, pages, effective_results, filings, history, latest, page, review_summary, weighted_confidence
from caskwise.plans.store import reviewed_ratio, uncached
from caskwise.plans.verify import full_findings, panel_blocks, scored, second_pass, transcripts, verified
from caskwise.session import shared_folder, table
from caskwise.sources import forms, readers
from caskwise.streaming.progress import drained

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


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return stated_quantities(table(spark, d, "applications"), table(spark, d, "comparison_results"), table(spark, d, "unit_reference"))


# --- read side -----------------------------------------------------------------------------------

_FILINGS = "(select * from applications where session_id is not null qualify row_number() over (partition by session_id order by submitted_at desc nulls last, row_id desc) = 1)"
_HISTORY = f"""
select s.session_id, a.brand_name, a.class_type, s.beverage_type, s.status, s.overall_confidence, s.created_at,
       coalesce(total_input_tokens, 0) + coalesce(total_output_tokens, 0) as total_tokens
from verification_sessions s left join {_FILINGS} a on s.session_id = a.session_id"""


@query("history_page", f"{_HISTORY} where s.status = 'pass' and lower(a.brand_name) like '%old%' order by s.created_at desc nulls last, s.session_id limit 20")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    return page(history(table(spark, d, "verification_sessions"), table(spark, d, "applications"), status="pass", brand="Old"))


@query("history_total", f"select status, beverage_type, count(*) as n from ({_HISTORY} where lower(a.brand_name) like '%old%') group by status, beverage_type")
def history_total(spark: SparkSession, d: str) -> DataFrame:
    shown = history(table(spark, d, "verification_sessions"), table(spark, d, "applications"), brand="Old")
    return shown.groupBy("status", "beverage_type").agg(F.count("*").alias("n"))


@query("batch_sessions", f"select s.batch_id, s.session_id, s.status, s.overall_confidence, a.brand_name from verification_sessions s left join {_FILINGS} a on s.session_id = a.session_id where s.batch_id is not null")
def batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    brands = filings(table(spark, d, "applications")).select("session_id", "brand_name")
    return table(spark, d, "verification_sessions").where("batch_id is not null").join(brands, "session_id", "left").select("batch_id", "session_id", "status", "overall_confidence", "brand_name")


@query("session_exists", "select status, count(*) as n from verification_sessions s where exists (select 1 from comparison_results c where c.session_id = s.session_id) group by status")
def session_exists(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "verification_sessions").join(table(spark, d, "comparison_results"), "session_id", "left_semi")
    return known.groupBy("status").agg(F.count("*").alias("n"))


@query("batch_progress", """
with seen as (
    select batch_id, count(*) as sessions, count(*) filter (status in ('pass', 'needs_review', 'fail')) as done, count(*) filter (status = 'fail') as failed
    from verification_sessions where batch_id is not null group by batch_id)
select b.batch_id, coalesce(sessions, 0) as sessions, coalesce(done, 0) as done, coalesce(failed, 0) as failed,
       cast(coalesce(floor(100.0 * coalesce(done, 0) / nullif(total_items, 0) + 0.5), 0) as bigint) as percent, coalesce(done, 0) - coalesce(completed_items, 0) as drift
from batches b left join seen on b.batch_id = seen.batch_id""")  # fmt: skip
def batch_progress_query(spark: SparkSession, d: str) -> DataFrame:
    return batch_progress(table(spark, d, "batches"), table(spark, d, "verification_sessions"))


@query("latest_feedback", "select session_id, ai_correct, field_name, note, created_at from agent_feedback where session_id is not null qualify row_number() over (partition by session_id order by created_at desc nulls last, feedback_id desc) = 1")
def latest_feedback(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "agent_feedback").where("session_id is not null")
    return latest(events, ["session_id"], ["created_at", "feedback_id"]).select("session_id", "ai_correct", "field_name", "note", "created_at")


_LATEST = "(select *, coalesce(nullif(override_status, ''), status) as effective_status from comparison_results qualify row_number() over (partition by session_id, field_name order by compared_at desc nulls last, result_id desc) = 1)"


@query("latest_override", f"select session_id, field_name, status, override_status, effective_status from {_LATEST}")
def latest_override(spark: SparkSession, d: str) -> DataFrame:
    return effective_results(table(spark, d, "comparison_results")).select("session_id", "field_name", "status", "override_status", "effective_status")


@query("status_counts", "select session_id, count(*) filter (status = 'match') as matched, count(*) filter (status = 'extraction_uncertain') as uncertain, count(*) filter (status in ('content_mismatch', 'field_missing')) as failed from comparison_results group by session_id")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    counts = (F.count_if(s == "match").alias("matched"), F.count_if(s == "extraction_uncertain").alias("uncertain"), F.count_if(s.isin("content_mismatch", "field_missing")).alias("failed"))
    return table(spark, d, "comparison_results").groupBy("session_id").agg(*counts)


@query("review_summary", f"""
select session_id, count(*) as total_fields, count(*) filter (status <> 'match') as flagged, count(*) filter (coalesce(reviewed, false) or override_status is not null) as reviewed,
       coalesce(string_agg(field_name, ',' order by field_name) filter (status <> 'match'), '') as flagged_names
from {_LATEST} group by session_id""")  # fmt: skip
def review_summary_query(spark: SparkSession, d: str) -> DataFrame:
    return review_summary(table(spark, d, "comparison_results"))


@query("weighted_confidence", f"""
select session_id, round(sum(confidence * coalesce(weight, 1.0::double)) / sum(coalesce(weight, 1.0::double)), 6) as confidence
from {_LATEST} c left join {weights_sql()} on c.field_name = w.field_name where confidence is not null group by session_id""")  # fmt: skip
def weighted_confidence_query(spark: SparkSession, d: str) -> DataFrame:
    return weighted_confidence(table(spark, d, "comparison_results"), weights(spark)).select("session_id", F.round("confidence", 6).alias("confidence"))


@query("usage_stats", """
select batch_id, count(*) as sessions, cast(coalesce(sum(total_llm_calls), 0) as bigint) as calls, cast(sum(coalesce(total_input_tokens, 0) + coalesce(total_output_tokens, 0)) as bigint) as tokens,
       cast(coalesce(sum(processing_time_ms), 0) as bigint) as ms, round(coalesce(sum(estimated_cost_usd), 0), 4) as cost
from verification_sessions group by batch_id""")  # fmt: skip
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    tokens = F.sum(F.coalesce("total_input_tokens", F.lit(0)) + F.coalesce("total_output_tokens", F.lit(0)))
    return table(spark, d, "verification_sessions").groupBy("batch_id").agg(
        F.count("*").alias("sessions"), zero("total_llm_calls").alias("calls"), tokens.alias("tokens"), zero("processing_time_ms").alias("ms"), F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 4).alias("cost")
    )


# --- evaluation ----------------------------------------------------------------------------------


@query("confusion_matrix", "select coalesce(status, 'none') as expected, coalesce(agent_decision, 'none') as actual, count(*) as n from verification_sessions group by 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return confusion(table(spark, d, "verification_sessions"), "status", "agent_decision")


@query("field_accuracy", f"""
select c.field_name, count(*) as total, count(*) filter (effective_status = status) as correct, round(count(*) filter (effective_status = status) * 1.0::double / count(*), 6) as accuracy
from {_LATEST} c where effective_status = status is not null group by c.field_name""")  # fmt: skip
def field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    judged = effective_results(table(spark, d, "comparison_results")).withColumn("same", F.col("effective_status") == F.col("status"))
    return accuracy(judged, "field_name", "same").withColumn("accuracy", F.round("accuracy", 6))


@query("eval_totals", """
select beverage_type, count(*) as evaluated, count(*) filter (ai_correct is null) as unjudged, count(*) filter (ai_correct) as correct,
       round(coalesce(avg(processing_time_ms), 0), 4) as avg_ms
from verification_sessions group by beverage_type""")  # fmt: skip
def eval_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verification_sessions").groupBy("beverage_type").agg(
        F.count("*").alias("evaluated"), F.count_if(F.col("ai_correct").isNull()).alias("unjudged"), F.count_if("ai_correct").alias("correct"), F.round(F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)), 4).alias("avg_ms")
    )


_FIELDS = ["brand_name", "class_type", "alcohol_content", "net_contents", "producer_name", "country_of_origin"]


def _long_sql(relation: str, value: str) -> str:
    return " union all ".join(f"select application_id, '{f}' as field_name, {f} as {value} from {relation}" for f in _FIELDS)


_FIRST_APP = "(select * from applications where application_id is not null qualify row_number() over (partition by application_id order by row_id) = 1)"
_FIRST_TEST = "(select * from test_applications where application_id is not null qualify row_number() over (partition by application_id order by row_id) = 1)"


@query("golden_diff", f"""
with a as ({_long_sql(_FIRST_APP, "old_value")}), b as ({_long_sql(_FIRST_TEST, "new_value")})
select coalesce(a.application_id, b.application_id) as application_id, coalesce(a.field_name, b.field_name) as field_name, old_value, new_value
from a full join b on a.application_id = b.application_id and a.field_name = b.field_name where old_value is distinct from new_value""")  # fmt: skip
def golden_diff(spark: SparkSession, d: str) -> DataFrame:
    first = lambda t: first_rows(table(spark, d, t).where("application_id is not null"), "application_id", "row_id")
    return differences(first("applications"), first("test_applications"), "application_id", _FIELDS)


@query("new_ids", "select distinct application_id from test_applications t where not exists (select 1 from applications a where a.application_id = t.application_id)")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test_applications").select("application_id").distinct().join(table(spark, d, "applications"), "application_id", "left_anti")


@query("ordered_dedupe", "select application_id, min(row_id) as row_id from test_applications group by application_id")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(table(spark, d, "test_applications"), "application_id", "row_id").select("application_id", "row_id")


@query("quick_subset", """
with c as (select batch_id, session_id, row_number() over (partition by batch_id order by session_id) as k, count(*) over (partition by batch_id) as n from verification_sessions)
select batch_id, session_id from c where k <= case when n <= 3 then 1 else 2 end""")  # fmt: skip
def quick_subset(spark: SparkSession, d: str) -> DataFrame:
    return stratified(table(spark, d, "verification_sessions").select("batch_id", "session_id"), "batch_id", "session_id")


@query("id_mapping", "select f.feedback_id, f.session_id, s.application_id, s.session_id is null as unknown from agent_feedback f left join verification_sessions s on f.session_id = s.session_id")
def id_mapping(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "verification_sessions").select("session_id", "application_id", F.lit(True).alias("known"))
    return table(spark, d, "agent_feedback").join(known, "session_id", "left").select("feedback_id", "session_id", "application_id", F.col("known").isNull().alias("unknown"))


@query("expected_vs_actual", f"""
select f.session_id, f.field_name, r.status, coalesce(f.ai_correct and r.status is not null, false) as correct
from (select session_id, field_name, ai_correct from agent_feedback where session_id is not null and field_name is not null qualify row_number() over (partition by session_id, field_name order by created_at desc nulls last, feedback_id desc) = 1) f
left join {_LATEST} r on f.session_id = r.session_id and f.field_name = r.field_name""")  # fmt: skip
def expected_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    answers = latest(table(spark, d, "agent_feedback").where("session_id is not null and field_name is not null"), ["session_id", "field_name"], ["created_at", "feedback_id"])
    results = effective_results(table(spark, d, "comparison_results")).select("session_id", "field_name", "status")
    correct = F.coalesce(F.col("ai_correct") & F.col("status").isNotNull(), F.lit(False)).alias("correct")
    return answers.select("session_id", "field_name", "ai_correct").join(results, ["session_id", "field_name"], "left").select("session_id", "field_name", "status", correct)


# --- text and number functions -------------------------------------------------------------------


@query("normalize_whitespace", r"select doc_id, trim(regexp_replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}\x{85}\x0b]+', ' ', 'g')) as text from documents")
def normalize_whitespace_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize_whitespace("text").alias("text"))


@query("slugs", r"select distinct brand_name, regexp_replace(regexp_replace(replace(replace(lower(brand_name), '&', 'and'), '''', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from applications where brand_name is not null")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").where("brand_name is not null").select("brand_name", X.slug("brand_name").alias("slug")).distinct()


_FUZZY = r"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_fuzzy", f"select row_id, {_FUZZY.format('brand_name')} as brand, {_FUZZY.format('producer_address')} as address from applications")
def normalize_fuzzy_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").select("row_id", X.normalize_fuzzy("brand_name").alias("brand"), X.normalize_fuzzy("producer_address").alias("address"))


@query("company_names", rf"""
select row_id, trim(regexp_replace(regexp_replace({_FUZZY.format("replace(coalesce(producer_name, ''), '&', ' and ')")}, '\b({X.COMPANY_SUFFIXES})\b', '', 'g'), '\s+', ' ', 'g')) as company from applications""")  # fmt: skip
def company_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").select("row_id", X.normalize_company("producer_name").alias("company"))


def _plain(value: str) -> str:
    """SQL: blanks and decimal digits of every script as ASCII."""
    blanks = "[" + X.BLANK[1:-1] + r"\x{feff}]"
    return f"translate(regexp_replace({value}, '{blanks}', ' ', 'g'), '{X._DIGITS}', '{X._ASCII_DIGITS}')"


def _abv(value: str) -> str:
    whole = X.wide(r"^\s*(\d+\.?\d*)\s*$")
    return rf"coalesce(try_cast(nullif(regexp_extract({value}, '{X.wide(r'(\d+\.?\d*)\s*%')}', 1), '') as double), try_cast(nullif(regexp_extract({value}, '{whole}', 1), '') as double))"


def _proof(value: str) -> str:
    return f"try_cast(nullif(regexp_extract({value}, '{X.wide(r'(\d+\.?\d*)\s*[Pp]roof')}', 1), '') as double)"


@query("abv_and_proof", f"select result_id, {_abv('v')} as abv, {_proof('v')} as proof from (select result_id, {_plain('extracted_value')} as v from comparison_results where field_name = 'alcohol_content')")
def abv_and_proof(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comparison_results").where("field_name = 'alcohol_content'").withColumn("plain", X.plain_numbers("extracted_value"))
    return rows.select("result_id", X.extract_abv("plain").alias("abv"), X.extract_proof("plain").alias("proof"))


def _volume_sql(value: str) -> str:
    tries = []
    for pattern, factor, unit in X.VOLUME_UNITS:
        got = f"try_cast(nullif(regexp_extract({value}, '{pattern}', 1), '') as double)"
        tries.append(f"when {got} is not null then {{'value': {got} * {factor}::double, 'unit': '{unit}'}}")
    return "case " + " ".join(tries) + " end"


@query("first_volume", f"select row_id, round((v).value, 6) as value, (v).unit as unit from (select row_id, {_volume_sql('net_contents')} as v from applications)")
def first_volume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").withColumn("v", X.net_contents("net_contents")).select("row_id", F.round("v.value", 6).alias("value"), "v.unit")


@query("beverage_infer", f"""
select row_id, case when regexp_matches(lower(class_type), '{"|".join(X.WINE_WORDS)}') then 'wine' when regexp_matches(lower(class_type), '{"|".join(X.BEER_WORDS)}') then 'beer' else 'distilled_spirits' end as inferred
from applications where class_type is not null""")  # fmt: skip
def beverage_infer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").where("class_type is not null").select("row_id", X.infer_beverage("class_type").alias("inferred"))


@query("panel_classify", "select doc_id, panel_type, case when regexp_matches(lower(panel_type), 'front|brand|collar') then 'front' when contains(lower(panel_type), 'back') then 'back' else 'other' end as panel from documents where panel_type is not null")
def panel_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("panel_type is not null").select("doc_id", "panel_type", X.classify_panel("panel_type").alias("panel"))


@query("image_files", r"""
select row_id, trim(f) as image, case when contains(lower(f), 'back') then 'back' when regexp_matches(lower(f), 'other|side|neck') then 'other' else 'front' end as panel
from (select row_id, unnest(string_split(images, ';')) as f from test_applications) where trim(f) <> ''""")  # fmt: skip
def image_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "test_applications").select("row_id", F.explode(F.split("images", ";")).alias("f")).where("trim(f) <> ''")
    return files.select("row_id", F.trim("f").alias("image"), X.panel_of_file("f").alias("panel"))


@query("confidence_bands", "select field_name, case when confidence >= 90 then 'high' when confidence >= 70 then 'medium' when confidence is not null then 'low' end as band, count(*) as n from comparison_results group by 1, 2")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comparison_results").groupBy("field_name", X.band("confidence").alias("band")).agg(F.count("*").alias("n"))


@query("cache_keys", "select doc_id, sha256(text || 'transcribe') as key from documents where text is not null")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.cache_key("text", "transcribe").alias("key"))


@query("json_fields", "select event_id, json_extract_string(props, '$.page') as page, json_extract_string(props, '$.ref') as ref from events where json_valid(props)")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where(F.try_parse_json("props").isNotNull())
    return events.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.ref").alias("ref"))


_BLANKS_SQL = "regexp_replace(coalesce({0}, ''), '[" + X.BLANK[1:-1] + r"\x{{feff}}]+', ' ', 'g')"
_BLANKS_SQL = _BLANKS_SQL.replace("{0}", "@").replace("{{", "{").replace("}}", "}")


def _split_sql(value: str) -> str:
    return f"list_filter(string_split({_BLANKS_SQL.replace('@', value)}, ' '), lambda t: t <> '')"


@query("word_diffs", f"""
with w as (select result_id, {_split_sql("declared_value")} as a, {_split_sql("extracted_value")} as b from comparison_results where field_name = 'brand_name')
select result_id, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: lower(a[i]) is null or lower(b[i]) is null or lower(a[i]) <> lower(b[i]))) as differing, greatest(len(a), len(b)) as words from w""")  # fmt: skip
def word_diffs(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "comparison_results").where("field_name = 'brand_name'")
    diff = brands.withColumn("diff", X.word_diff(X.plain_blanks("declared_value"), X.plain_blanks("extracted_value")))
    return diff.select("result_id", F.size(F.filter("diff", lambda x: ~x["same"])).cast("bigint").alias("differing"), F.size("diff").cast("bigint").alias("words"))


@query("document_links", r"""
with l as (select doc_id, unnest(regexp_extract_all(text, '(https?://[^\s"''<>)\]|]+)', 1)) as link from documents)
select doc_id, link, lower(regexp_extract(link, '^https?://([^/:?#]+)', 1)) as host from l""")  # fmt: skip
def document_links(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.explode(forms.links(F.col("text"))).alias("link"))
    return found.select("doc_id", "link", forms.host(F.col("link")).alias("host"))


@query("next_lines", r"""
with l as (
    select doc_id, unnest(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x))) as line, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) as i
    from documents where panel_type is not null),
p as (select doc_id, i, line, lead(line) over (partition by doc_id order by i) as follows from l)
select doc_id, arg_min(follows, i) as follows from p where contains(lower(line), 'control label') and follows <> '' and not contains(lower(follows), 'control label') group by doc_id""")  # fmt: skip
def next_lines(spark: SparkSession, d: str) -> DataFrame:
    panels = table(spark, d, "documents").where("panel_type is not null")
    return panels.select("doc_id", forms.next_line(F.col("text"), "control label").alias("follows")).where("follows is not null")


@query("panel_blocks", """
select session_id, cast(doc_id // 1000 as bigint) as block, count(*) as n, string_agg(text, chr(10) order by doc_id) as text
from documents where session_id is not null and panel_type is not null and text is not null group by 1, 2""")  # fmt: skip
def panel_blocks_query(spark: SparkSession, d: str) -> DataFrame:
    return panel_blocks(table(spark, d, "documents"))


@query("class_lookup", """
with names as (
    select class_id, lower(strip_accents(class_name)) as name from class_reference
    union select class_id, lower(strip_accents(trim(a))) from (select class_id, unnest(string_split(aliases, '|')) as a from class_reference) where a is not null)
select row_id, min(class_id) as class_id from applications join names on lower(strip_accents(trim(class_type))) = name group by row_id""")  # fmt: skip
def class_lookup(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "class_reference").select("class_id", F.explode(F.split(F.concat_ws("|", "class_name", "aliases"), r"\|")).alias("name"))
    fold = lambda c: X.fold_marks(F.lower(F.trim(c)))
    names = ref.select("class_id", fold(F.col("name")).alias("name")).distinct()
    apps = table(spark, d, "applications").select("row_id", fold(F.col("class_type")).alias("name"))
    return apps.join(names, "name").groupBy("row_id").agg(F.min("class_id").alias("class_id"))


# --- matchers ------------------------------------------------------------------------------------

_PAIRS = f"""pairs as (
    select a.session_id, d.doc_id, d.text, a.brand_name, a.alcohol_content, a.net_contents, a.producer_name, a.producer_address, a.country_of_origin, a.has_sulfites_declaration
    from {_FILINGS} a join documents d on a.session_id = d.session_id where d.panel_type is not null and d.text is not null)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return filings(table(spark, d, "applications")).join(transcripts(table(spark, d, "documents")), "session_id")


_WORDS = r"list_distinct(list_filter(string_split_regex({0}, '\s+'), lambda t: t <> ''))"
_ABV_SQL = _abv("alcohol_content")
_PCT_SQL = X.wide(r"""list_transform(list_filter(list_concat(regexp_extract_all(text, '(\d+\.?\d*)\s*%', 1), regexp_extract_all(text, '(?i)ALC(?:OHOL)?\.?\s*/?\s*VOL(?:UME)?\.?\s*(\d+\.?\d*)', 1),
    regexp_extract_all(text, '(?i)(\d+\.?\d*)\s*ALC(?:OHOL)?\.?\s*/?\s*VOL(?:UME)?\.?', 1), regexp_extract_all(text, '(?i)ALC\.?\s+(\d+\.?\d*)\s*(?:BY\s+VOL)?', 1)), lambda x: x <> ''), lambda x: x::double)""")


@query("abv_match", f"""
with {_PAIRS}, n as (select session_id, doc_id, {_ABV_SQL} as want, {_PCT_SQL} as have from pairs where alcohol_content <> ''),
m as (select session_id, doc_id, list_min(list_transform(have, lambda p: abs(p - want))) as near, want from n)
select session_id, doc_id, case when want is null or near is null then 'field_missing' when near <= 0.1 then 'match' when near <= 5.0 then 'extraction_uncertain' else 'content_mismatch' end as status from m""")  # fmt: skip
def abv_match(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("alcohol_content <> ''").select("session_id", "doc_id", M.match_abv(F.col("alcohol_content"), F.col("text"))["status"].alias("status"))


def _all_volumes_sql(text: str) -> str:
    return "list_concat(" + ", ".join(f"list_transform(regexp_extract_all({text}, '{p}', 1), lambda x: x::double * {f}::double)" for p, f in M._VOLUMES) + ")"


_DECLARED_SQL = f"""list_filter(list_transform(list_filter(list_transform(string_split(net_contents, chr(10)), lambda s: trim(s)), lambda s: s <> ''), lambda s: {_volume_sql("s")}), lambda v: v is not null)"""


@query("net_contents_match", f"""
with {_PAIRS}, n as (
    select session_id, doc_id, list_transform({_DECLARED_SQL}, lambda v: case when (v).unit = 'fl oz' then (v).value * {X.FL_OZ}::double else (v).value end) as want, {_all_volumes_sql("text")} as have
    from pairs where net_contents <> '')
select session_id, doc_id, case when len(want) = 0 or len(have) = 0 then 'field_missing'
    when len(list_filter(have, lambda h: len(list_filter(want, lambda w: abs(h - w) < 5.0)) > 0)) > 0 then 'match' else 'content_mismatch' end as status from n""")  # fmt: skip
def net_contents_match(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("net_contents <> ''").select("session_id", "doc_id", M.match_net_contents(F.col("net_contents"), F.col("text"))["status"].alias("status"))


@query("brand_tokens", f"""
with {_PAIRS}, n as (select session_id, doc_id, {_WORDS.format(_FUZZY.format("brand_name"))} as want, {_WORDS.format(_FUZZY.format("text"))} as have from pairs where brand_name <> '' and text <> ''),
m as (select *, list_filter(want, lambda w: not list_contains(have, w)) as lacking from n)
select session_id, doc_id, case when len(want) = 0 then 0.0::double when len(lacking) = 0 then 100.0::double
    when len(list_filter(lacking, lambda w: len(w) >= 4 and len(list_filter(have, lambda t: starts_with(t, w))) > 0)) = len(lacking) then 100.0::double - 5.0 * len(lacking) end as confidence from m""")  # fmt: skip
def brand_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("brand_name <> '' and text <> ''").select("session_id", "doc_id", M.words_found(F.col("brand_name"), F.col("text"))["confidence"].alias("confidence"))


_COMPANY = r"trim(regexp_replace(regexp_replace(" + _FUZZY.replace("{0}", "replace(coalesce({0}, ''), '&', ' and ')") + rf", '\b({X.COMPANY_SUFFIXES})\b', '', 'g'), '\s+', ' ', 'g'))"


@query("company_tokens", f"""
with {_PAIRS}, n as (select session_id, doc_id, {_WORDS.format(_COMPANY.format("producer_name"))} as want, {_WORDS.format(_COMPANY.format("text"))} as have from pairs where producer_name <> '' and text <> ''),
m as (select *, len(list_filter(want, lambda w: list_contains(have, w))) as hits from n)
select session_id, doc_id, round(case when len(want) = 0 then 0.0::double when hits = len(want) then 100.0::double when 100.0::double * hits / len(want) >= 60 then least(100.0::double * hits / len(want), 95.0::double) end, 6) as confidence from m""")  # fmt: skip
def company_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("producer_name <> '' and text <> ''").select("session_id", "doc_id", F.round(M.company_found(F.col("producer_name"), F.col("text"))["confidence"], 6).alias("confidence"))


@query("presence_check", "select doc_id, contains(lower(text), 'sulfites') as present from documents where text is not null")
def presence_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", (M.presence("sulfites", F.col("text"))["status"] == "match").alias("present"))


@query("canonical_passage", rf"""
with n as (select doc_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g')), '([\p{{L}}\p{{N}}_])-\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\((\d+)\)([\p{{L}}\p{{N}}_])', '(\1) \2', 'g'), '(\S)(\(\d+\))', '\1 \2', 'g')) as s from documents where panel_type is not null)
select doc_id, case when contains(s, lower('{M.NOTICE}')) then 'match' when not contains(s, 'caution') then 'field_missing' end as status from n""")  # fmt: skip
def canonical_passage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("panel_type is not null").select("doc_id", M.passage_found(F.col("text"))["status"].alias("status"))


@query("canonical_passage_full")
def canonical_passage_full(spark: SparkSession, d: str) -> DataFrame:
    panels = table(spark, d, "documents").where("panel_type is not null").select("doc_id", "text")
    return M.match_passage(panels, "text", "v").select("doc_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


@query("find_text_full")
def find_text_full(spark: SparkSession, d: str) -> DataFrame:
    return M.match_text(_pairs(spark, d).where("brand_name <> ''").select("session_id", "doc_id", "brand_name", "text"), "brand_name", "text", "v").select("session_id", "doc_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


@query("company_full")
def company_full(spark: SparkSession, d: str) -> DataFrame:
    return M.match_company(_pairs(spark, d).where("producer_name <> ''").select("session_id", "doc_id", "producer_name", "text"), "producer_name", "text", "v").select("session_id", "doc_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


@query("address_full")
def address_full(spark: SparkSession, d: str) -> DataFrame:
    return M.match_address(_pairs(spark, d).where("producer_address <> ''").select("session_id", "doc_id", "producer_address", "text"), "producer_address", "text", "v").select("session_id", "doc_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


@query("value_scores")
def value_scores(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "comparison_results").where("declared_value is not null").select("result_id", "field_name", "declared_value", "extracted_value")
    return M.score_values(values, "declared_value", "extracted_value", "score").select("result_id", "field_name", F.round("score", 4).alias("score"))


@query("similarity_kernels")
def similarity_kernels(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "comparison_results").where("field_name = 'brand_name' and declared_value is not null and extracted_value is not null")
    a, b = X.normalize_fuzzy("declared_value"), X.normalize_fuzzy("extracted_value")
    kernels = (("ratio", K.ratio_udf), ("partial", K.partial_ratio_udf), ("token_sort", K.token_sort_udf), ("token_set", K.token_set_udf), ("fuzzy", K.fuzzy_udf))
    return brands.select("result_id", *(F.round(f(a, b), 4).alias(n) for n, f in kernels))


@query("abv_agreement", f"""
with p as (select result_id, {_plain("extracted_value")} as x, {_plain("declared_value")} as y from comparison_results where field_name = 'alcohol_content'),
v as (select result_id, nullif(x, '') as e, {_abv("x")} as a, {_abv("y")} as b, {_proof("x")} as p from p)
select result_id, case when e is null or a is null then 'field_missing' when b is null then 'content_mismatch' when abs(a - b) <= 0.1 then 'match' else 'content_mismatch' end as status,
       coalesce(abs(p - a * 2) > 0.5, false) as proof_differs from v""")  # fmt: skip
def abv_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comparison_results").where("field_name = 'alcohol_content'")
    return rows.select("result_id", M.abv_agrees(X.plain_numbers("extracted_value"), X.plain_numbers("declared_value")).alias("v")).select("result_id", "v.*")


@query("contents_agreement")
def contents_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comparison_results").where("field_name = 'net_contents' and declared_value is not null")
    return rows.select("result_id", M.contents_agree(F.col("extracted_value"), F.col("declared_value"))["status"].alias("status"))


_SESSION_TEXTS = f"""texts as (
    select session_id, doc_id // 1000 as doc_id, string_agg(text, chr(10) order by doc_id) as text from documents where session_id is not null and panel_type is not null and text is not null group by 1, 2),
pairs as (
    select a.session_id, d.doc_id, d.text, a.brand_name, a.alcohol_content, a.net_contents, a.producer_name, a.producer_address, a.country_of_origin, a.has_sulfites_declaration
    from {_FILINGS} a join texts d on a.session_id = d.session_id)"""


@query("verify_pipeline", f"""
with {_SESSION_TEXTS},
brand as (select session_id, doc_id, 'brand_name' as field_name, {_WORDS.format(_FUZZY.format("brand_name"))} as want, {_WORDS.format(_FUZZY.format("text"))} as have, 1.5::double as w from pairs where brand_name <> ''
    union all select session_id, doc_id, 'country_of_origin', {_WORDS.format(_FUZZY.format("country_of_origin"))}, {_WORDS.format(_FUZZY.format("text"))}, 0.8 from pairs where country_of_origin <> ''),
brand2 as (select *, list_filter(want, lambda w: not list_contains(have, w)) as lacking from brand),
company as (select session_id, doc_id, {_WORDS.format(_COMPANY.format("producer_name"))} as want, {_WORDS.format(_COMPANY.format("text"))} as have from pairs where producer_name <> ''),
company2 as (select *, len(list_filter(want, lambda w: list_contains(have, w))) as hits from company),
abv as (select session_id, {_ABV_SQL} as want, {_PCT_SQL} as have from pairs where alcohol_content <> ''),
abv2 as (select session_id, want, list_min(list_transform(have, lambda p: abs(p - want))) as near from abv),
net as (select session_id, list_transform({_DECLARED_SQL}, lambda v: case when (v).unit = 'fl oz' then (v).value * {X.FL_OZ}::double else (v).value end) as want, {_all_volumes_sql("text")} as have from pairs where net_contents <> ''),
f as (
    select session_id, field_name, w, case when len(want) = 0 then 1 when len(lacking) = 0 or len(list_filter(lacking, lambda w: len(w) >= 4 and len(list_filter(have, lambda t: starts_with(t, w))) > 0)) = len(lacking) then 4 else 2 end as rank,
        case when len(want) = 0 then 0.0::double when len(lacking) = 0 then 100.0::double when len(list_filter(lacking, lambda w: len(w) >= 4 and len(list_filter(have, lambda t: starts_with(t, w))) > 0)) = len(lacking) then 100.0::double - 5.0 * len(lacking) else 0.0::double end as c from brand2
    union all select session_id, 'producer_name', 1.0, case when len(want) = 0 then 1 when 100.0 * hits / len(want) >= 60 then 4 else 2 end,
        case when len(want) = 0 then 0.0 when hits = len(want) then 100.0::double when 100.0::double * hits / len(want) >= 60 then least(100.0::double * hits / len(want), 95.0::double) else 0.0 end from company2
    union all select session_id, 'alcohol_content', 1.5, case when want is null or near is null then 1 when near <= 0.1 then 4 when near <= 5.0 then 3 else 2 end, case when near <= 0.1 then 100.0 when near <= 5.0 then 50.0 else 0.0 end from abv2
    union all select session_id, 'net_contents', 1.0, case when len(want) = 0 or len(have) = 0 then 1 when len(list_filter(have, lambda h: len(list_filter(want, lambda w: abs(h - w) < 5.0)) > 0)) > 0 then 4 else 2 end,
        case when len(list_filter(have, lambda h: len(list_filter(want, lambda w: abs(h - w) < 5.0)) > 0)) > 0 then 100.0 else 0.0 end from net
    union all select session_id, 'sulfites_declaration', 0.5, case when contains(lower(text), 'sulfites') then 4 else 1 end, case when contains(lower(text), 'sulfites') then 100.0 else 0.0 end from pairs where has_sulfites_declaration),
best as (select session_id, field_name, any_value(w) as w, max(row(rank, c)) as b, max(rank) as rank, arg_max(c, rank * 1000 + c) as c from f group by session_id, field_name)
select session_id, count(*) as fields, count(*) filter (rank = 4) as matched, count(*) filter (rank = 3) as uncertain, round(sum(c * w) / sum(w), 4) as confidence from best group by session_id""")  # fmt: skip
def verify_pipeline(spark: SparkSession, d: str) -> DataFrame:
    fields = "brand_name alcohol_content net_contents producer_name country_of_origin sulfites_declaration".split()
    scored = verified(table(spark, d, "applications"), table(spark, d, "documents"), weights(spark), fields)
    return scored.withColumn("confidence", F.round("confidence", 4))


@query("verify_findings")
def verify_findings(spark: SparkSession, d: str) -> DataFrame:
    return full_findings(table(spark, d, "applications"), table(spark, d, "documents"), _variants(spark, d))


@query("verify_full")
def verify_full(spark: SparkSession, d: str) -> DataFrame:
    return scored(verify_findings(spark, d), weights(spark)).withColumn("confidence", F.round("confidence", 4))


@query("second_pass", f"""
with r as (select session_id, field_name, status, confidence, compared_at, result_id, row_number() over (partition by session_id, field_name order by compared_at nulls first, result_id) as k, row_number() over (partition by session_id, field_name order by compared_at desc nulls last, result_id desc) as z from comparison_results),
f as (select * from r where k = 1), l as (select * from r where z = 1 and status = 'match')
select f.session_id, f.field_name, case when f.status <> 'match' and l.session_id is not null then 'match' else f.status end as status, coalesce(f.status <> 'match' and l.session_id is not null, false) as replaced
from f left join l on f.session_id = l.session_id and f.field_name = l.field_name""")  # fmt: skip
def second_pass_query(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "comparison_results").select("session_id", "field_name", "status", "confidence", "compared_at", "result_id")
    rest = F.struct("status", "confidence")
    order = F.struct("compared_at", "result_id")
    both = results.groupBy("session_id", "field_name").agg(F.min_by(rest, order).alias("a"), F.max_by(rest, order).alias("z"))
    return second_pass(both.select("session_id", "field_name", "a.*"), both.select("session_id", "field_name", "z.*")).select("session_id", "field_name", "status", "replaced")


@query("missing_fields", """
with need as (select * from (values ('brand_name'), ('class_type'), ('alcohol_content'), ('net_contents'), ('producer_name')) as n(field_name))
select s.session_id, n.field_name from (select distinct session_id from comparison_results) s cross join need n
where not exists (select 1 from comparison_results c where c.session_id = s.session_id and c.field_name = n.field_name and coalesce(c.extracted_value, '') <> '')""")  # fmt: skip
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "comparison_results")
    need = F.explode(F.array(*map(F.lit, ["brand_name", "class_type", "alcohol_content", "net_contents", "producer_name"]))).alias("field_name")
    return results.select("session_id").distinct().select("session_id", need).join(results.where("extracted_value <> ''"), ["session_id", "field_name"], "left_anti")


@query("quarantine_split", """
select doc_id, case when text is null or text = '' then 'empty' when length(text) is distinct from n_chars then 'wrong length' when source is null then 'no source' when lang is null or not regexp_full_match(lang, '[a-z]{2}') then 'language' end as reason from documents""")  # fmt: skip
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    checks = {"empty": F.col("text") != "", "wrong length": F.char_length("text") == F.col("n_chars"), "no source": F.col("source").isNotNull(), "language": F.col("lang").rlike("^[a-z]{2}$")}
    return readers.quarantine(table(spark, d, "documents"), checks).select("doc_id", "reason")


@query("declared_long", "select row_id, field_name, value from (select row_id, unnest(['brand_name', 'class_type', 'alcohol_content', 'net_contents', 'producer_name', 'country_of_origin']) as field_name, unnest([brand_name, class_type, alcohol_content, net_contents, producer_name, country_of_origin]) as value from applications) where value <> ''")
def declared_long(spark: SparkSession, d: str) -> DataFrame:
    return long_form(table(spark, d, "applications"), "row_id", _FIELDS).where("value <> ''")


@query("ground_truth_build", "select row_id, application_id, lower(has_sulfites_declaration) = 'true' as sulfites, coalesce(importer_name, '') <> '' as imported, len(list_filter(string_split(images, ';'), lambda x: trim(x) <> '')) as images from test_applications")
def ground_truth_build(spark: SparkSession, d: str) -> DataFrame:
    files = F.size(F.filter(F.split("images", ";"), lambda x: F.trim(x) != "")).cast("bigint")
    return table(spark, d, "test_applications").select(
        "row_id", "application_id", (F.lower("has_sulfites_declaration") == "true").alias("sulfites"), X.present("importer_name").alias("imported"), F.when(F.col("images").isNotNull(), files).alias("images")
    )


@query("page_exclusion", "select d.doc_id from documents d where d.session_id is not null and not exists (select 1 from verification_sessions s where s.session_id = d.session_id and s.status = 'pass')")
def page_exclusion(spark: SparkSession, d: str) -> DataFrame:
    passed = table(spark, d, "verification_sessions").where("status = 'pass'")
    return table(spark, d, "documents").where("session_id is not null").join(passed, "session_id", "left_anti").select("doc_id")


@query("stream_progress", "select batch_id, count(*) as sessions, count(*) filter (status <> 'pending') as done, count(*) filter (status = 'fail') as failed from verification_sessions where batch_id is not null group by batch_id")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    return drained(spark, d, "verification_sessions.parquet")


@query("json_lines_roundtrip", "select result_id, field_name, status, confidence from comparison_results")
def json_lines_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comparison_results").select("result_id", "field_name", "status", "confidence")
    out = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows.write.json(out)
    return readers.read_lines(spark, out, "result_id bigint, field_name string, status string, confidence double").drop("_corrupt")


@query("tpch_pricing", """
select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")  # fmt: skip
def tpch_pricing(spark: SparkSession, d: str) -> DataFrame:
    shipped = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


# --- designations, fields found on their own -----------------------------------------------------


@query("qualifier_strip", f"select row_id, class_type, {C.strip_sql('class_type')} as base from applications where class_type is not null")
def qualifier_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").where("class_type is not null").select("row_id", "class_type", C.strip_qualifiers(F.col("class_type"))["base"].alias("base"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "class_reference")
    return ref.select(F.explode(F.split(F.concat_ws("|", "class_name", "aliases"), r"\|")).alias("variant"), F.col("class_name").alias("canonical"))


@query("class_normalize")
def class_normalize(spark: SparkSession, d: str) -> DataFrame:
    typed = table(spark, d, "applications").select("row_id", "class_type")
    return C.normalize_classes(typed, "class_type", _variants(spark, d))


@query("class_match_full")
def class_match_full(spark: SparkSession, d: str) -> DataFrame:
    pairs = filings(table(spark, d, "applications")).join(transcripts(table(spark, d, "documents")), "session_id").where("class_type <> ''").select("session_id", "doc_id", "class_type", "text")
    return M.match_class(pairs, "class_type", "text", _variants(spark, d), "v").select("session_id", "doc_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


_COUNTRY_SQL = "case lower(trim(country_of_origin)) " + " ".join(f"when '{a}' then '{b}'" for a, b in C.COUNTRIES.items()) + " else country_of_origin end"


@query("country_names", f"select row_id, {_COUNTRY_SQL} as country from applications where country_of_origin is not null")
def country_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").where("country_of_origin is not null").select("row_id", C.country(F.col("country_of_origin")).alias("country"))


@query("address_values")
def address_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comparison_results").where("field_name = 'producer_address' and declared_value is not null").select("result_id", "declared_value", "extracted_value")
    return M.address_value(rows, "extracted_value", "declared_value", "v").select("result_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


@query("fuzzy_values")
def fuzzy_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comparison_results").where("field_name in ('brand_name', 'producer_name', 'country_of_origin') and declared_value is not null").select("result_id", "declared_value", "extracted_value")
    return M.fuzzy_value(rows, "extracted_value", "declared_value", "v").select("result_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


@query("exact_values")
def exact_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comparison_results").where("field_name = 'government_warning'").select("result_id", F.lit(M.NOTICE).alias("declared_value"), "extracted_value")
    return M.exact_value(rows, "extracted_value", "declared_value", "v").select("result_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


@query("review_progress", f"""
select session_id, round(case when count(*) filter (status <> 'match') = 0 then 1.0::double else count(*) filter (status <> 'match' and reviewed) * 1.0::double / count(*) filter (status <> 'match') end, 6) as ratio,
       count(*) filter (status <> 'match' and not coalesce(reviewed, false)) = 0 as done, min(field_name) filter (status <> 'match' and not coalesce(reviewed, false)) as next
from {_LATEST} group by session_id""")  # fmt: skip
def review_progress(spark: SparkSession, d: str) -> DataFrame:
    return reviewed_ratio(effective_results(table(spark, d, "comparison_results"))).withColumn("ratio", F.round("ratio", 6))


@query("panel_positions", """
with p as (select distinct session_id, doc_id, panel_type from documents where session_id is not null and panel_type is not null)
select session_id, count(*) as panels, count(distinct panel_type) as kinds, arg_min(panel_type, doc_id) as first_panel from p group by session_id""")  # fmt: skip
def panel_positions(spark: SparkSession, d: str) -> DataFrame:
    panels = table(spark, d, "documents").where("session_id is not null and panel_type is not null").select("session_id", "doc_id", "panel_type").distinct()
    return panels.groupBy("session_id").agg(F.count("*").alias("panels"), F.count_distinct("panel_type").alias("kinds"), F.min_by("panel_type", "doc_id").alias("first_panel"))


@query("uncached_documents", "select doc_id from documents d where text is not null and sha256(text || 'transcribe') not in (select sha256(text || 'transcribe') from documents where source = 'label_transcript' and text is not null)")
def uncached_documents(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").where("text is not null").withColumn("key", X.cache_key("text", "transcribe"))
    return uncached(keyed, keyed.where("source = 'label_transcript'"), "key").select("doc_id")


@query("repaired_replies", """
select result_id, json_extract_string(to_json({'value': extracted_value, 'conf': extraction_confidence}), '$.value') as value, coalesce(extraction_confidence, 'high') as conf
from comparison_results where extracted_value is not null""")  # fmt: skip
def repaired_replies(spark: SparkSession, d: str) -> DataFrame:
    field = F.struct(F.col("extracted_value").alias("value"), F.col("extraction_confidence").alias("conf"))
    # every reply stands in a code fence and is broken off before its closing brackets
    whole = F.to_json(F.struct(field.alias("f")))
    broken = F.concat(F.lit("```json\n"), F.substring(whole, F.lit(1), F.char_length(whole) - 2))
    replies = table(spark, d, "comparison_results").where("extracted_value is not null").select("result_id", broken.alias("reply"))
    return readers.reply_fields(replies, "reply").select("result_id", F.col("fields")["f"]["value"].alias("value"), F.col("fields")["f"]["conf"].alias("conf"))


# --- further operators ---------------------------------------------------------------------------


@query("filing_categories", f"select row_id, (v).is_administrative as is_administrative, (v).spirit as spirit from (select row_id, {C.administrative_sql('class_type')} as v from applications)")
def filing_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "applications").select("row_id", C.administrative(F.col("class_type")).alias("v")).select("row_id", "v.*")


@query("class_values")
def class_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "comparison_results").where("field_name = 'class_type' and declared_value is not null").select("result_id", "declared_value", "extracted_value")
    return M.class_value(rows, "extracted_value", "declared_value", _variants(spark, d), "v").select("result_id", "v.status", F.round("v.confidence", 4).alias("confidence"))


@query("present_values", "select result_id, case when coalesce(extracted_value, '') <> '' then 'match' else 'field_missing' end as status from comparison_results")
def present_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comparison_results").select("result_id", M.present_value(F.col("extracted_value"))["status"].alias("status"))


@query("history_pages", "select status, cast(ceil(count(*) / 20.0) as bigint) as pages from verification_sessions group by status")
def history_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "verification_sessions").groupBy("status").agg(pages(F.count("*")).alias("pages"))


@query("listed_order", "select session_id, coalesce(nullif(coalesce(list_position(['fail', 'needs_review', 'pass'], status), 0), 0), 999) as place from verification_sessions where status is not null")
def listed_order(spark: SparkSession, d: str) -> DataFrame:
    place = by_position(F.col("status"), ["fail", "needs_review", "pass"]).alias("place")
    return table(spark, d, "verification_sessions").where("status is not null").select("session_id", place).orderBy("place", "session_id")


@query("batch_outcome", "select batch_id, case when total_items = failed_items then 'failed' else 'completed' end as outcome from batches")
def batch_outcome(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batches").select("batch_id", final_status(F.col("total_items"), F.col("failed_items")).alias("outcome"))


@query("media_types", r"""
select row_id, trim(f) as image, case when regexp_matches(lower(f), '\.png$') then 'image/png' when regexp_matches(lower(f), '\.webp$') then 'image/webp' when regexp_matches(lower(f), '\.gif$') then 'image/gif' else 'image/jpeg' end as media_type
from (select row_id, trim(unnest(string_split(images, ';'))) as f from test_applications) where f <> ''""")  # fmt: skip
def media_types(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "test_applications").select("row_id", F.explode(F.split("images", ";")).alias("f")).select("row_id", F.trim("f").alias("image")).where("image <> ''")
    return files.select("row_id", "image", X.media_type("image").alias("media_type"))


@query("encoded_documents", "select doc_id, sha256(to_base64(encode(text))) as digest from documents where text is not null")
def encoded_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", ""), 256).alias("digest"))
