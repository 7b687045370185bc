import pytest
from pyspark.sql import functions as F

from caskwise.functions import classes as C
from caskwise.operators import matchers as M
from caskwise.plans.store import Store, reviewed_ratio, uncached, with_cached
from caskwise.sources import forms


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    sessions = spark.createDataFrame([("s", "needs_review", 70.0)], "session_id string, status string, overall_confidence double")
    apps = spark.createDataFrame([("s", "Old Anvil")], "session_id string, brand_name string")
    results = spark.createDataFrame([("s", "f", "field_missing"), ("s", "g", "match")], "session_id string, field_name string, status string")
    store.add_sessions(sessions, apps, results, "c1")
    store.add_sessions(sessions, apps, results, "c1")
    assert store.committed("sessions").count() == 1
    refused = store.decide(spark.createDataFrame([(1, "s", "confirmed", "a", 1), (2, "s", "overridden", "b", 2), (3, "none", "confirmed", "", 3), (4, "s", "maybe", "", 4)], "event_id int, session_id string, decision string, notes string, at int"))
    assert {r["event_id"] for r in refused.collect()} == {3, 4}
    row = store.sessions().first()
    assert (row["status"], row["agent_decision"], row["agent_notes"]) == ("needs_review", "overridden", "b")
    refused = store.override(spark.createDataFrame([(1, "s", "f", "match", "seen", 1), (2, "s", "h", "match", "", 1), (3, "s", "f", "extraction_uncertain", "", 2)], "event_id int, session_id string, field_name string, override_status string, override_note string, at int"))
    assert {r["event_id"] for r in refused.collect()} == {2, 3}
    got = {r["field_name"]: (r["status"], r["effective_status"], r["reviewed"]) for r in store.results().collect()}
    assert got == {"f": ("field_missing", "match", True), "g": ("match", "match", False)}


def test_rows_without_a_marker_are_not_shown(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([("s",)], "session_id string")
    store.add_sessions(a, a, a, "c1")
    from caskwise.sources.readers import append

    append(spark.createDataFrame([("lost", "c2")], "session_id string, commit_id string"), str(tmp_path / "store/sessions"))
    assert [r["session_id"] for r in store.committed("sessions").collect()] == ["s"]


def test_cache(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    cache = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y")], "key string, value string")
    assert rows(uncached(df, cache, "key")) == rows(spark.createDataFrame([("b",), (None,)], "key string"))
    assert rows(with_cached(df, cache, "key", "value")) == rows(spark.createDataFrame([("a", "x"), ("b", None), (None, None)], "key string, value string"))


def test_reviewed_ratio(spark):
    df = spark.createDataFrame([("s", "b", "field_missing", None), ("s", "a", "content_mismatch", True), ("t", "a", "match", False)], "session_id string, field_name string, status string, reviewed boolean")
    got = {r["session_id"]: (r["ratio"], r["done"], r["next"]) for r in reviewed_ratio(df).collect()}
    assert got == {"s": (0.5, False, "b"), "t": (1.0, True, None)}


VARIANTS = [("whiskey", "whiskey"), ("bourbon", "bourbon whiskey"), ("rose wine", "rose wine"), ("red wine", "red wine"), ("flavored vodka", "flavored vodka"), (None, "x")]


@pytest.mark.parametrize(("typed", "want"), [
    ("Whisky", "whiskey"), ("BOURBON", "bourbon whiskey"), ("Rosé Wine", "rose wine"), ("Table Red Wine", "red wine"), ("Peach Flavored Vodka", "flavored vodka"), ("small batch bourbon finished in port casks", "bourbon whiskey"),
    ("Premium Whisky with honey", "whiskey"), ("gin", None), ("", None), (None, None), ("red wine (under 14%)", "red wine"),
])
def test_normalize_classes(spark, typed, want):
    variants = spark.createDataFrame(VARIANTS, "variant string, canonical string")
    df = spark.createDataFrame([(1, typed), (1, typed)], "id int, c string")
    assert [r["canonical"] for r in C.normalize_classes(df, "c", variants).collect()] == [want, want]


def test_match_class(spark):
    variants = spark.createDataFrame([("rum", "rum"), ("cachaça", "rum"), ("gin", "gin")], "variant string, canonical string")
    df = spark.createDataFrame([(1, "Premium Rum", "fine rum"), (2, "Rum", "Cachaça do Sul"), (3, "Gin", "nothing of it"), (4, None, "x"), (5, "Great Oddity", "a great odditty")], "id int, c string, t string")
    got = {r["id"]: (r["v"]["status"], r["v"]["confidence"]) for r in M.match_class(df, "c", "t", variants, "v").collect()}
    assert got[1] == ("match", 100.0)
    assert got[2] == ("match", 90.0)
    assert got[3][0] == "content_mismatch"
    assert got[4] == ("field_missing", 0.0)
    assert got[5] == ("match", pytest.approx(200 * 11 / 24))  # eleven letters of twelve, in a window of twelve


def test_values_found_on_their_own(spark):
    df = spark.createDataFrame([(1, "Salem, Oregon", "1 Elm Rd, Salem OR"), (2, "", "x"), (3, "Paris", "1 Elm Rd, Salem OR")], "id int, f string, d string")
    got = {r["id"]: r["v"]["status"] for r in M.address_value(df, "f", "d", "v").collect()}
    assert got == {1: "match", 2: "field_missing", 3: "content_mismatch"}
    df = spark.createDataFrame([(1, "ALCO-HOL\n is", "alcohol is"), (2, "wine is", "alcohol is"), (3, None, "x")], "id int, f string, d string")
    got = {r["id"]: r["v"]["status"] for r in M.exact_value(df, "f", "d", "v").collect()}
    assert got == {1: "match", 2: "content_mismatch", 3: "content_mismatch"}
    df = spark.createDataFrame([(1, "Cascade Winery", "Cascade Winery Inc"), (2, "Fete", "Lenz Moser Fete Rose"), (3, None, "x")], "id int, f string, d string")
    got = {r["id"]: r["v"]["status"] for r in M.fuzzy_value(df, "f", "d", "v").collect()}
    assert got == {1: "match", 2: "content_mismatch", 3: "field_missing"}


def test_country_names(spark):
    df = spark.createDataFrame([("España",), ("Chile",), (None,)], "c string")
    assert [r[0] for r in df.select(C.country(F.col("c"))).collect()] == ["spain", "Chile", None]


def test_images(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(forms.is_label_image(F.lit(9000), F.lit(800), F.lit(600))) is True
    assert one(forms.is_label_image(F.lit(9000), F.lit(900), F.lit(150))) is False
    assert one(forms.is_label_image(F.lit(100), F.lit(800), F.lit(600))) is False
    assert one(forms.is_label_image(F.lit(None), F.lit(800), F.lit(600))) is False
    pixel = lambda v: F.struct(*(F.lit(v).alias(c) for c in "rgb"))
    assert one(forms.is_signature(F.array(*[pixel(250)] * 9, pixel(0)))) is True
    assert one(forms.is_signature(F.array(*[pixel(250)] * 5, *[pixel(0)] * 5))) is False
    box = F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(33.3).alias("width"), F.lit(50.0).alias("height"))
    assert tuple(one(forms.box_pixels(box, F.lit(200), F.lit(100)))) == (20, 20, 66, 50)
    assert tuple(one(forms.fitted(F.lit(3136), F.lit(100)))) == (1568, 50)


def test_form_blocks(spark):
    text = "NAME AND ADDRESS OF APPLICANT\nDSP-KY-123 Anvil Holdings LLC\n1 Elm Road\nSalem, OR 97301\nOld Anvil (Trade Name)\nMAILING ADDRESS\nx\nNET CONTENTS ALCOHOL\n750 milliliters 40.5\n1 liter (total 33.8 fl oz)"
    row = spark.createDataFrame([(text,), ("",)], "t string").select(forms.applicant(F.col("t"), "name and address of applicant", "mailing address").alias("a"), forms.sizes_and_strength(F.col("t")).alias("n")).collect()
    assert tuple(row[0]["a"]) == ("Old Anvil", "1 Elm Road, Salem, OR 97301")
    assert row[0]["n"]["sizes"] == ["750 milliliters", "1 liter"]
    assert row[0]["n"]["strength"] == "40.5"
    assert row[1]["a"]["name"] is None
