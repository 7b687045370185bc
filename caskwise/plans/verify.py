"""The verification plan: declared fields against the text of every transcript, scored per session.

Transcripts of a session are joined in order of their ids by blocks of ids, so a value may run over panels; the best
finding of a field over the blocks counts, so a session of very many transcripts is never brought together in one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caskwise.operators.matchers import address_found, company_found, match_abv, match_address, match_brand, match_class, match_company, match_net_contents, match_passage, match_text, presence, words_found
from caskwise.plans.history import filings
from caskwise.session import cut

#: Order of the findings, worst first, when panels disagree.
ORDER = ["field_missing", "content_mismatch", "extraction_uncertain", "match"]


def transcripts(documents: DataFrame) -> DataFrame:
    """(session_id, doc_id, text) of label transcripts."""
    return documents.where("session_id is not null and panel_type is not null and text is not null").select("session_id", "doc_id", "text")


def panel_blocks(documents: DataFrame, block: int = 1000) -> DataFrame:
    """(session_id, block, n, text): transcripts of a session joined in order of their ids, by blocks of ids.

    Blocks bound what one task joins, however many panels a session has.
    """
    panels = transcripts(documents).withColumn("block", F.floor(F.col("doc_id") / block))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda p: p["text"]), "\n")
    return panels.groupBy("session_id", "block").agg(F.count("*").alias("n"), joined.alias("text"))


def _native(declared: Column, text: Column, rung: Column) -> Column:
    open_end = F.struct(F.lit("content_mismatch").alias("status"), F.lit(0.0).alias("confidence"))
    return F.coalesce(rung, open_end)


def findings(applications: DataFrame, documents: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(session_id, field_name, status, confidence): the best finding of each declared field, or of `only` some, by native rungs alone (`full_findings` has all).

    Fields that aren't asked for stay out of the plan; the expressions of an address are large.
    """
    pairs = filings(applications).join(panel_blocks(documents), "session_id")
    text = F.col("text")
    fields = {
        "brand_name": lambda c: _native(c, text, words_found(c, text)),
        "alcohol_content": lambda c: match_abv(c, text),
        "net_contents": lambda c: match_net_contents(c, text),
        "producer_name": lambda c: _native(c, text, company_found(c, text)),
        "producer_address": lambda c: _native(c, text, address_found(c, text)),
        "country_of_origin": lambda c: _native(c, text, words_found(c, text)),
    }
    entries = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("declared"), m(F.col(f)).alias("v")) for f, m in fields.items() if only is None or f in only]
    sulfites = F.struct(F.lit("sulfites_declaration").alias("field_name"), F.when(F.col("has_sulfites_declaration"), "Required").alias("declared"), presence("sulfites", text).alias("v"))
    long = pairs.select("session_id", F.explode(F.array(*entries, *([sulfites] if only is None or "sulfites_declaration" in only else []))).alias("f")).where("f.declared is not null and f.declared <> ''")
    return best_findings(long.select("session_id", "f.field_name", "f.v"))


def best_findings(found: DataFrame) -> DataFrame:
    """(session_id, field_name, status, confidence): of (session_id, field_name, v) of every transcript the best of each field."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("v.status"))
    best = found.groupBy("session_id", "field_name").agg(F.max(F.struct(rank.alias("rank"), F.col("v.confidence").alias("confidence"))).alias("b"))
    return best.select("session_id", "field_name", F.element_at(F.array(*map(F.lit, ORDER)), F.col("b.rank").cast("int")).alias("status"), "b.confidence")


def full_findings(applications: DataFrame, documents: DataFrame, variants: DataFrame) -> DataFrame:
    """(session_id, field_name, status, confidence): the best finding of each declared field by its full ladder.

    Similarity kernels run on what the native rungs leave undecided. The passage is looked for in every session that has a
    filing and a transcript; `variants` (variant, canonical) are the class designations.
    """
    ladders = {
        "brand_name": match_brand,
        "class_type": lambda df, c, text, out: match_class(df, c, text, variants, out),
        "alcohol_content": lambda df, c, text, out: df.withColumn(out, match_abv(F.col(c), F.col(text))),
        "net_contents": lambda df, c, text, out: df.withColumn(out, match_net_contents(F.col(c), F.col(text))),
        "producer_name": match_company,
        "producer_address": match_address,
        "country_of_origin": match_text,
        "importer_name": match_company,
        "importer_address": match_address,
    }
    pairs = cut(filings(applications).select("session_id", *ladders, "has_sulfites_declaration").join(panel_blocks(documents), "session_id"))
    found = [m(pairs.where(F.col(f) != "").select("session_id", f, "text"), f, "text", "v").select("session_id", F.lit(f).alias("field_name"), "v") for f, m in ladders.items()]
    found.append(pairs.where("has_sulfites_declaration").select("session_id", F.lit("sulfites_declaration").alias("field_name"), presence("sulfites", F.col("text")).alias("v")))
    found.append(match_passage(pairs.select("session_id", "text"), "text", "v").select("session_id", F.lit("government_warning").alias("field_name"), "v"))
    return best_findings(reduce(DataFrame.unionByName, found))


def verified(applications: DataFrame, documents: DataFrame, weights: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(session_id, fields, matched, uncertain, confidence) of every session that has a filing and a transcript."""
    return scored(findings(applications, documents, only), weights)


def scored(found: DataFrame, weights: DataFrame) -> DataFrame:
    """(session_id, fields, matched, uncertain, confidence) of the findings of every session."""
    w = F.coalesce("weight", F.lit(1.0))
    return (
        found.join(F.broadcast(weights), "field_name", "left")
        .groupBy("session_id")
        .agg(
            F.count("*").alias("fields"),
            F.count_if(F.col("status") == "match").alias("matched"),
            F.count_if(F.col("status") == "extraction_uncertain").alias("uncertain"),
            F.coalesce(F.try_divide(F.sum(F.col("confidence") * w), F.sum(w)), F.lit(0.0)).alias("confidence"),
        )
    )


def second_pass(first: DataFrame, again: DataFrame) -> DataFrame:
    """Findings of a second look replace the first only where they match and the first didn't."""
    retry = again.where("status = 'match'").select("session_id", "field_name", F.lit(True).alias("replaced"), F.col("confidence").alias("again"))
    joined = first.join(retry, ["session_id", "field_name"], "left")
    taken = (F.col("status") != "match") & F.coalesce("replaced", F.lit(False))
    return joined.select("session_id", "field_name", F.when(taken, "match").otherwise(F.col("status")).alias("status"), F.when(taken, F.col("again")).otherwise(F.col("confidence")).alias("confidence"), taken.alias("replaced"))
