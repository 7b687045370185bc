"""Filing categories, classes found on their own, merged maps, batches of the store."""

import pytest
from pyspark.sql import functions as F

from caskwise.functions.classes import administrative
from caskwise.functions.text import media_type
from caskwise.operators import matchers as M
from caskwise.plans.history import by_position, final_status, merged, pages
from caskwise.plans.store import Store


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("WHISKY  Specialties", (True, "whisky")), ("brandy specialties", (True, "brandy")), ("tequila proprietary", (True, "tequila")), ("cheese specialties", (False, None)), ("Other Herb & Seed Cordials/Liqueurs", (True, None)),
    ("malt beverage specialties - x", (True, None)), ("gin", (False, None)), ("  ", (False, None)), (None, (False, None)), ("Other\u00a0wine specialties", (True, None)),
])
def test_administrative(spark, text, want):
    assert tuple(one(spark, administrative(F.lit(text).cast("string")))) == want


def test_class_values(spark):
    variants = spark.createDataFrame([("gin", "gin"), ("bourbon whiskey", "bourbon whiskey"), ("bourbon", "bourbon whiskey")], "variant string, canonical string")
    data = [(1, "Bourbon", "Bourbon Whisky"), (2, "Gin", "Bourbon"), (3, None, "Gin"), (4, " ", "Gin"), (5, "Tequila 100% Agave Blanco", "Blanco Tequila"), (6, "Pisco Acholado", "Pisko Acholado"), (7, "x", "Grappa"), (7, "x", "Grappa")]
    got = sorted((r["id"], r["v"]["status"], r["v"]["confidence"] >= 85) for r in M.class_value(spark.createDataFrame(data, "id int, f string, d string"), "f", "d", variants, "v").collect())
    assert got == [(1, "match", True), (2, "content_mismatch", False), (3, "field_missing", False), (4, "field_missing", False), (5, "match", True), (6, "match", True), (7, "content_mismatch", False), (7, "content_mismatch", False)]


def test_class_of_a_filing_category_is_uncertain(spark):
    variants = spark.createDataFrame([("gin", "gin")], "variant string, canonical string")
    df = spark.createDataFrame([("gin specialties", "a gin label"), ("gin", "a gin label")], "c string, text string")
    assert {r["c"]: r["v"]["status"] for r in M.match_class(df, "c", "text", variants, "v").collect()} == {"gin specialties": "extraction_uncertain", "gin": "match"}


def test_small_functions(spark):
    assert [one(spark, pages(F.lit(n))) for n in (0, 1, 20, 21)] == [0, 1, 1, 2]
    assert [one(spark, by_position(F.lit(x).cast("string"), ["a", "b"])) for x in ("b", "z", None)] == [2, 999, 999]
    assert [one(spark, final_status(F.lit(a), F.lit(b))) for a, b in ((2, 2), (2, 1))] == ["failed", "completed"]
    maps = [F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.lit(None).cast("map<string,int>"), F.create_map(F.lit("b"), F.lit(2))]
    assert one(spark, merged(*maps)) == {"a": 1, "b": 2}
    assert [one(spark, media_type(F.lit(x).cast("string"))) for x in ("x.PNG", "y", None)] == ["image/png", "image/jpeg", None]


def test_mismatch_keeps_its_similarity(spark):
    df = spark.createDataFrame([("Silver Otter Reserve", "Silver Ottor Reserv label")], "d string, t string")
    brand, text = (m(df, "d", "t", "v").first()["v"] for m in (M.match_brand, M.match_text))
    assert brand["confidence"] == text["confidence"]
    assert 85 <= brand["confidence"]


def test_store_without_events(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path))
    at = "timestamp'2026-01-01 00:00:00'"
    session = spark.sql(f"select 's1' session_id, 'pass' status, {at} created_at")
    store.add_sessions(session, spark.sql("select 's1' session_id, 'x' brand_name"), spark.sql("select 's1' session_id, 'brand_name' field_name, 'match' status"), "c1")
    assert [(r["status"], r["agent_decision"]) for r in store.sessions().collect()] == [("pass", None)]
    assert [(r["effective_status"], r["reviewed"]) for r in store.results().collect()] == [("match", False)]
    answers = spark.sql(f"select * from values ('e1', 's1', true, null, null, {at}), ('e2', 'none', true, null, null, {at}) as t(event_id, session_id, ai_correct, field_name, note, at)")
    assert [r["event_id"] for r in store.feedback(answers.select("event_id", "session_id", "ai_correct", F.col("note").cast("string").alias("note"), "at")).collect()] == ["e2"]
    store.add_batch(spark.sql(f"select 'b1' batch_id, 2L total_items, {at} created_at"), spark.sql("select 'b1' batch_id, 'x.pdf' item, 'empty' reason"))
    assert [r["status"] for r in store.read("batches").collect()] == ["processing"]
