import json

import pytest
from pyspark.sql import functions as F

from caskwise.functions.graph import components
from caskwise.plans import evals, history, verify
from caskwise.sources import forms, readers


def test_latest_wins(spark, rows):
    df = spark.createDataFrame([("a", 1, 1, "old"), ("a", 2, 2, "new"), ("a", 2, 3, "newest"), ("b", None, 4, "only"), (None, 1, 5, "null key")], "k string, ts int, id int, v string")
    assert rows(history.latest(df, ["k"], ["ts", "id"]).select("k", "v")) == rows(spark.createDataFrame([("a", "newest"), ("b", "only"), (None, "null key")], "k string, v string"))


SESSIONS = "session_id string, beverage_type string, status string, overall_confidence double, created_at timestamp_ntz, total_input_tokens bigint, total_output_tokens bigint"


def test_history_filters_and_pages(spark):
    sessions = spark.sql("select concat('s', id) session_id, 'wine' beverage_type, if(id % 2 = 0, 'pass', 'fail') status, 1d overall_confidence, timestamp_ntz'2024-01-01 00:00:00' created_at, id total_input_tokens, cast(null as bigint) total_output_tokens from range(30)")
    apps = spark.sql("select id row_id, concat('s', id % 30) session_id, concat('Old_', id % 30) brand_name, 'x' class_type, timestamp_ntz'2024-01-01 00:00:00' submitted_at from range(60)")
    shown = history.history(sessions, apps, status="pass", beverage_type="", brand="old_1")
    assert {r["session_id"] for r in shown.collect()} == {"s10", "s12", "s14", "s16", "s18"}
    assert history.history(sessions, apps).count() == 30
    pages = [r["session_id"] for n in (1, 2) for r in history.page(history.history(sessions, apps), n, 20).collect()]
    assert len(set(pages)) == 30
    with pytest.raises(ValueError, match="page"):
        history.page(sessions, 0)


def test_override_never_changes_the_status(spark):
    df = spark.createDataFrame([(1, "s", "f", "match", "content_mismatch", True, 100.0), (2, "s", "g", "field_missing", None, False, 0.0)], "result_id int, session_id string, field_name string, status string, override_status string, reviewed boolean, confidence double").withColumn("compared_at", F.lit(1))
    got = {r["field_name"]: (r["status"], r["effective_status"]) for r in history.effective_results(df).collect()}
    assert got == {"f": ("match", "content_mismatch"), "g": ("field_missing", "field_missing")}
    s = history.review_summary(df).first()
    assert (s["total_fields"], s["flagged"], s["reviewed"], s["flagged_names"]) == (2, 1, 1, "g")
    weights = spark.createDataFrame([("f", 3.0)], "field_name string, weight double")
    assert history.weighted_confidence(df, weights).first()["confidence"] == 75.0
    assert history.weighted_confidence(df.limit(0), weights).count() == 0


def test_batch_progress(spark):
    batches = spark.createDataFrame([("b", 4, 1), ("e", 0, 0)], "batch_id string, total_items bigint, completed_items bigint")
    sessions = spark.createDataFrame([("b", "pass"), ("b", "fail"), ("b", "pending"), (None, "pass")], "batch_id string, status string")
    got = {r["batch_id"]: (r["sessions"], r["done"], r["failed"], r["percent"], r["drift"]) for r in history.batch_progress(batches, sessions).collect()}
    assert got == {"b": (3, 2, 1, 50, 1), "e": (0, 0, 0, 0, 0)}


def test_second_pass_replaces_only_matches(spark, rows):
    a = spark.createDataFrame([("s", "x", "content_mismatch", 0.0), ("s", "y", "match", 100.0), ("s", "z", "field_missing", 0.0)], "session_id string, field_name string, status string, confidence double")
    b = spark.createDataFrame([("s", "x", "match", 90.0), ("s", "y", "match", 1.0), ("s", "z", "content_mismatch", 5.0)], a.schema)
    assert rows(verify.second_pass(a, b)) == [("s", "x", "match", 90.0, True), ("s", "y", "match", 100.0, False), ("s", "z", "field_missing", 0.0, False)]


def test_verified_takes_the_best_panel(spark):
    apps = spark.createDataFrame([(1, "s", "Old Anvil", "40%", "750 mL", "", "", None, True)], "row_id bigint, session_id string, brand_name string, alcohol_content string, net_contents string, producer_name string, producer_address string, country_of_origin string, has_sulfites_declaration boolean").withColumn("submitted_at", F.lit(1))
    docs = spark.createDataFrame([(1, "s", "front", "OLD ANVIL"), (2, "s", "back", "40% vol 375 ml contains SULFITES"), (3, None, "back", "x"), (4, "s", "back", None)], "doc_id bigint, session_id string, panel_type string, text string")
    weights = spark.createDataFrame([("brand_name", 2.0)], "field_name string, weight double")
    got = verify.verified(apps, docs, weights).first()
    assert (got["fields"], got["matched"], got["uncertain"]) == (4, 3, 0)
    assert got["confidence"] == pytest.approx(80.0)
    assert verify.panel_blocks(docs).first()["text"] == "OLD ANVIL\n40% vol 375 ml contains SULFITES"


def test_differences_and_subsets(spark, rows):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", "w"), (3, "n", None)], a.schema)
    assert rows(evals.differences(a, b, "id", ["p", "q"])) == [(2, "q", "z", "w"), (3, "p", None, "n")]
    df = spark.sql("select if(id < 2, 'few', 'many') g, id from range(10)")
    assert rows(evals.stratified(df, "g", "id")) == [("few", 0), ("many", 2), ("many", 3)]
    assert rows(evals.accuracy(spark.createDataFrame([("f", True), ("f", None), ("f", False)], "f string, ok boolean"), "f", "ok")) == [("f", 2, 1, 0.5)]


def test_components_against_brute_force(spark):
    import random

    random.seed(4)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, k) for k in range(201, 260)]
    parent = {n: n for link in links for n in link}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, y in links:
        parent[max(find(x), find(y))] = min(find(x), find(y))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 1), (5, 5)], "a int, b int")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_forms(spark):
    text = "SERIAL NUMBER\n12\nBRAND NAME (Required)\n\nFANCIFUL NAME\nNight Harvest\nBRAND NAME\nOld Anvil\nCLASS/TYPE\nTable Red Wine\npermit NY-I-490"
    got = spark.createDataFrame([(text,)], "t string").select(forms.assemble(F.col("t")).alias("f")).first()["f"]
    assert (got["brand_name"], got["fanciful_name"], got["class_type"], got["permit"], got["source_of_product"], got["beverage_type"], got["new_form"]) == ("Old Anvil", "Night Harvest", "Table Red Wine", "NY-I-490", "imported", "wine", False)


@pytest.mark.parametrize(("reply", "want"), [('{"a": 1}', {"a": 1}), ('```json\n{"a": "x"}\n```', {"a": "x"}), ('{"a": {"value": "x", "conf": "low"', {"a": {"value": "x", "conf": "low"}}), ('so: "a": "x", "b": 2 and more', {"a": "x", "b": 2}), ("nothing", None), ("", None), (None, None)])
def test_repair(reply, want):
    got = readers.repair_json(reply)
    assert (json.loads(got) if got else None) == want


def test_reply_fields(spark):
    df = spark.createDataFrame([(1, '{"a": {"value": "x", "conf": "low"}, "b": "y"}'), (2, '{"a": "z"'), (3, "nothing"), (4, None)], "id int, r string")
    got = {r["id"]: {k: tuple(v) for k, v in (r["fields"] or {}).items()} for r in readers.reply_fields(df, "r").collect()}
    assert got == {1: {"a": ("x", "low"), "b": ("y", "high")}, 2: {"a": ("z", "high")}, 3: {}, 4: {}}


def test_csv_and_append(spark, tmp_path):
    p = tmp_path / "apps.csv"
    names = readers.APPLICATION_CSV.replace(" string", "").replace(" ", "")
    p.write_text(f'{names}\na,"Old, Anvil",x,40%,"750 mL\n1 L",,,,,,wine,True,f.jpg;b.jpg\n')
    row = readers.read_applications(spark, str(p)).first()
    assert (row["brand_name"], row["net_contents"], row["producer_name"], row["has_sulfites_declaration"], row["images"]) == ("Old, Anvil", "750 mL\n1 L", None, True, ["f.jpg", "b.jpg"])
    t = str(tmp_path / "t")
    readers.append(spark.createDataFrame([(1,)], "a int"), t)
    readers.append(spark.createDataFrame([(2, "x")], "a int, b string"), t)
    assert {tuple(r) for r in readers.read_merged(spark, t).select("a", "b").collect()} == {(1, None), (2, "x")}


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: r["reason"] for r in readers.quarantine(df, {"empty": F.col("t") != ""}).collect()}
    assert got == {1: None, 2: "empty", 3: "empty"}


def test_full_findings_by_all_rungs(spark):
    from caskwise.operators.matchers import NOTICE

    fields = "brand_name class_type alcohol_content net_contents producer_name producer_address country_of_origin importer_name importer_address".split()
    declared = ["Floskborough Reserve", "Bourbon Whiskey", "40%", "750 mL", "Tammontis Zo", "12 Wonlow Road, Hesswick", "Germany", "Quindara Imports", "7 Prestoway Lane, Ustervale"]
    apps = spark.createDataFrame([(1, "s", *declared, True, None)], "row_id bigint, session_id string, " + ", ".join(f"{f} string" for f in fields) + ", has_sulfites_declaration boolean, submitted_at timestamp_ntz")
    label = "FLOSKBOROUGN RESERVE bourbon whiskey 40% vol 750 ml contains sulfites Tammontis Z0 12 Won1ow Road, Hesswlck Germany " + NOTICE.replace("DRIVERS", "DR1VERS")
    docs = spark.createDataFrame([(1, "s", "front", label), (2, "s", "back", "Quindara Imports, 7 Prestoway Lane, Ustervale")], "doc_id bigint, session_id string, panel_type string, text string")
    variants = spark.createDataFrame([("bourbon whiskey", "Bourbon Whiskey")], "variant string, canonical string")
    got = {r["field_name"]: r["status"] for r in verify.full_findings(apps, docs, variants).collect()}
    assert set(got) == {*fields, "sulfites_declaration", "government_warning"}
    assert {f for f, v in got.items() if v != "match"} == set()
    native = {r["field_name"]: r["status"] for r in verify.findings(apps, docs).collect()}
    assert native["brand_name"] == native["producer_name"] == "content_mismatch"
    assert verify.scored(verify.full_findings(apps, docs, variants), spark.createDataFrame([("brand_name", 2.0)], "field_name string, weight double")).first()["fields"] == 11
    assert verify.full_findings(apps, docs.limit(0), variants).count() == 0
