import itertools
import random

import pytest
from pyspark.sql import functions as F

from caskwise.functions import kernels as K
from caskwise.functions import text as X
from caskwise.operators import matchers as M


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("f", "text", "want"), [
    (X.normalize_whitespace, "BEV-\nERAGES \t of x ", "BEVERAGES of x"), (X.normalize_whitespace, None, None), (X.normalize_notice, "ALCO- HOLIC (1)According defects.(2) x", "ALCOHOLIC (1) According defects. (2) x"),
    (X.extract_abv, "Alc. 40.5 % vol", 40.5), (X.extract_abv, "35", 35.0), (X.extract_abv, "thirty", None), (X.extract_proof, "90 Proof", 90.0), (X.extract_proof, "", None),
    (X.normalize_fuzzy, "Château  d'Élan!", "chateau d elan"), (X.normalize_fuzzy, None, ""), (X.normalize_fuzzy, "Россия", "россия"), (X.normalize_company, "Anvil & Sons Co., LLC", "anvil and sons"),
    (X.slug, "Tom's Gin & Rum!", "toms-gin-and-rum"), (X.eval_text, "  A \n b ", "a b"), (X.eval_text, None, ""), (X.infer_beverage, "Imported Porter", "wine"), (X.infer_beverage, "Pale Ale", "beer"), (X.infer_beverage, None, "distilled_spirits"),
    (X.classify_panel, "Neck Collar", "front"), (X.classify_panel, "BACK label", "back"), (X.panel_of_file, "side_1.jpg", "other"), (X.infer_origin, "NY-I-490", "imported"), (X.infer_origin, "dsp-ky-1", "domestic"), (X.infer_origin, "x", None),
])
def test_scalars(spark, f, text, want):
    assert one(spark, f(F.col("x")), x=text) == want


@pytest.mark.parametrize(("text", "want"), [("12 FL. OZ.", (12.0, "fl oz")), ("750 ml", (750.0, "mL")), ("75 cL", (750.0, "mL")), ("1.5 Litres", (1500.0, "mL")), ("1 U.S. Gallon", (3785.41, "mL")), ("none", None), (None, None)])
def test_net_contents(spark, text, want):
    got = one(spark, X.net_contents("x"), x=text)
    assert (tuple(got) if got else None) == want


def test_address_tokens_fold_states_in_order(spark):
    assert sorted(one(spark, X.address_tokens("x"), x="42 Old Mill Rd, Asheville, North Carolina 28801")) == ["asheville", "mill", "nc", "old"]
    assert sorted(one(spark, X.address_tokens("x"), x="Wheeling, West Virginia")) == ["va", "west", "wheeling"]
    assert one(spark, X.address_tokens("x"), x=None) == []


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_kernels_against_brute_force():
    random.seed(1)
    for _ in range(300):
        a, b = ("".join(random.choices("abc ", k=random.randrange(9))) for _ in "xx")
        assert K.lcs(a, b) == naive_lcs(a, b)
        assert 0 <= K.ratio(a, b) <= 100
        assert K.ratio(a, b) == K.ratio(b, a)
        assert K.token_sort_ratio(a, b) == K.token_sort_ratio(b, a)
        assert K.token_set_ratio(a, b) == pytest.approx(K.token_set_ratio(b, a))
        if a.strip() and b.strip() and len(a) < len(b):
            windows = [b[max(0, e - len(a)) : min(e, len(b))] for e in range(1, len(b) + len(a))]
            assert K.partial_ratio(a, b) == pytest.approx(max(K.ratio(a, w) for w in windows))
    assert K.token_set_ratio("a b", "b c a") == 100
    assert K.token_set_ratio("", "a") == 0
    assert K.ratio("abcd", "abed") == 75


def test_bit_parallel_long():
    a, b = "ab" * 400, "ba" * 300
    assert K.lcs(a, b) == naive_lcs(a, b)


@pytest.mark.parametrize(("declared", "text", "status"), [("40%", "ALC. 40% BY VOL", "match"), ("40", "42 % x", "extraction_uncertain"), ("40", "90% agave", "content_mismatch"), ("40%", "no number", "field_missing"), ("x", "40%", "field_missing"), ("40", "40.1 %", "extraction_uncertain"), (None, None, "field_missing")])
def test_abv(spark, declared, text, status):
    assert one(spark, M.match_abv(F.col("a"), F.col("b"))["status"], a=declared, b=text) == status


@pytest.mark.parametrize(("declared", "text", "status"), [("750 mL\n1 L", "1000 ml", "match"), ("750 mL", "25.4 FL OZ", "match"), ("750 mL", "375 ml", "content_mismatch"), ("?", "750 ml", "field_missing"), ("750 ml", "x", "field_missing"), ("0.75 L", "750 ml", "match")])
def test_contents(spark, declared, text, status):
    assert one(spark, M.match_net_contents(F.col("a"), F.col("b"))["status"], a=declared, b=text) == status


def test_text_ladder(spark, rows):
    df = spark.createDataFrame([(1, "Old Anvil", "THE OLD ANVIL RYE", "k"), (2, "Blau", "Blaufrankisch", "k"), (3, "Old Anvill", "the old anvil rye", "k"), (4, "Zebra", "the old anvil rye", "k"), (5, None, "x", "k"), (6, "?!", "x", "k"), (7, "Gin", "", "k")], "id int, d string, t string, confidence string")
    got = {r["id"]: (r["v"]["status"], r["v"]["confidence"]) for r in M.match_text(df, "d", "t", "v").collect()}
    assert got[1] == ("match", 100.0)
    assert got[2] == ("match", 95.0)
    assert got[3][0] == "match"
    assert got[3][1] == 90.0  # one letter of ten
    assert got[4][0] == "content_mismatch"
    assert {got[i] for i in (5, 6, 7)} == {("field_missing", 0.0)}
    assert M.match_text(df.limit(0), "d", "t", "v").count() == 0


def test_company_and_address_rungs(spark):
    assert one(spark, M.company_found(F.col("a"), F.col("b"))["confidence"], a="Mill & Sons Brewing Co", b="brewed by mill and sons brewing") == 100
    assert one(spark, M.company_found(F.col("a"), F.col("b"))["confidence"], a="one two three", b="one two") == pytest.approx(66.6667, abs=1e-3)
    assert one(spark, M.address_found(F.col("a"), F.col("b"))["status"], a="1 Elm Rd, Salem, Oregon", b="bottled in Salem OR") == "match"
    assert one(spark, M.address_found(F.col("a"), F.col("b")), a="Salem", b="Salem") is None


def test_passage_ladder(spark):
    notice = M.NOTICE
    df = spark.createDataFrame([(1, "x " + notice.replace("DRIVERS", "DRI-\nVERS")), (2, "CAUTION: STRONG DRINK. NOT FOR MINORS, DRlVERS OR EXPECTANT MOTHERS."), (3, "caution: wet floor"), (4, "nothing"), (5, "")], "id int, t string")
    got = {r["id"]: r["v"]["status"] for r in M.match_passage(df, "t", "v").collect()}
    assert got == {1: "match", 2: "match", 3: "content_mismatch", 4: "field_missing", 5: "field_missing"}


@pytest.mark.parametrize(("found", "declared", "want"), [("750 ml", "750 mL", "match"), ("25.4 fl oz", "750 mL", "match"), ("751 ml", "750 ml", "content_mismatch"), ("7500 ml", "750 ml", "extraction_uncertain"), ("", "750 ml", "field_missing"), ("1 ml", "x", "content_mismatch")])
def test_contents_agree(spark, found, declared, want):
    assert one(spark, M.contents_agree(F.col("a"), F.col("b"))["status"], a=found, b=declared) == want


def test_word_diff(spark):
    got = one(spark, X.word_diff(F.col("a"), F.col("b")), a="One two three", b="one TWO")
    assert [(r["want"], r["got"], r["same"]) for r in got] == [("One", "one", True), ("two", "TWO", True), ("three", "___", False)]


def test_native_rungs_need_no_python(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").select(M.words_found(F.col("a"), F.col("b")), M.match_abv(F.col("a"), F.col("b")), M.address_found(F.col("a"), F.col("b")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_scores_are_symmetric_in_order_of_rows(spark, rows):
    data = [(i, a, b) for i, (a, b) in enumerate(itertools.product(["x y", "y", None, ""], repeat=2))]
    df = spark.createDataFrame(data, "id int, a string, b string")
    assert rows(M.score_values(df, "a", "b", "s")) == rows(M.score_values(df.orderBy(F.desc("id")), "a", "b", "s"))


def test_brand_matches_by_partial_ratio_from_85(spark):
    df = spark.createDataFrame([("tammonti", "zz qq tammontx rr vv")], "a string, b string")
    assert M.match_text(df, "a", "b", "v").first()["v"]["status"] == "content_mismatch"
    got = M.match_brand(df, "a", "b", "v").first()["v"]
    assert (got["status"], got["confidence"]) == ("match", 87.5)
