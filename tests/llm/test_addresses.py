import itertools
import math

import pytest
from pyspark.sql import functions as F

from caskwise.llm import addresses as A

SAME = [
    ["1086 Willow Street, Suite 47, Fort Kondport, TX 26431", "1086 WILLW STR. - FT KONDPORRT, Texas 26431-0043", "Fort Kondport, 1086 Willow St.", "#1086 Willow, Ft. Kondport"],
    ["PO Box 230, Cegham, KY 84137", "p o box 230, cegham, kentucky", "POB 230 Cegham", "Post Office Box 230, Cegham, Ky 84137", "KY 84137, P.O. Box 230"],
    ["Milgatestraße 81, 64913 Grinerode, Germany", "milgate-str. 81\ngrinerode\nde", "Milgattestr. 81, Grinerode"],
    ["900 Tenth Highway, Saint Hembville, IN 12175", "St Hembville 900 10th IN 12175"],
    ["4406 West Chapel Lane, North Tembborough, CA 42225", "N TEMBBOROUGH, 4406 CHAPEL LN W", "4406 W. Chapel Ln. CA 42225"],
    ["67, Cessvane Rd. - QX353 8AB Menetulloch - United Kingdom", "67 Cessvane Road, Menetulloch"],
]
APART = [
    ("1086 Willow Street, Fort Kondport, TX 26431", "1186 Willow Street, Fort Kondport, TX 26431"), ("5013 Granary Court, Lake Drimbwater, VA 72275", "5013 Granary Avenue, Lake Drimbwater, VA 72275"),
    ("135 East Sycamore Lane, Tornridge, MI 38975", "135 West Sycamore Lane, Tornridge, MI 38975"), ("212 East Vineyard Place, Mount Fonddale, MN 51406", "212 East Vineyard Place, Port Lombridge, PA 37437"),
    ("PO Box 12, Cegham, KY 84137", "12 Mill Road, Cegham, KY 84137"),
]


def found(spark, values):
    df = spark.createDataFrame([(v, None, "clash", 1) for v in values], "producer_address string, importer_address string, location string, number int")
    return {tuple(r) for r in A.same_location(df).collect()}


def test_known_groups(spark):
    values = list(dict.fromkeys([*itertools.chain(*SAME), *itertools.chain(*APART)]))
    want = {tuple(sorted(p)) for g in SAME for p in itertools.combinations(g, 2)}
    got = found(spark, values)
    assert want <= got
    assert not got & {tuple(sorted(p)) for p in APART}


def test_left_out_part_that_fits_two_places_fits_none(spark):
    values = ["7 Mill Court, Cegham, KY 84137", "7 Mill Lane, Cegham, KY 84137", "7 Mill, Cegham"]
    assert found(spark, values) == set()


def test_town_without_state_that_fits_two_fits_none(spark):
    values = ["12 Main Street, Springfield, IL 62701", "12 Main Street, Springfield, MA 01101", "12 Main Street, Springfield"]
    assert found(spark, values) == set()
    assert found(spark, values[1:]) == {("12 Main Street, Springfield", "12 Main Street, Springfield, MA 01101")}


def test_nulls_towns_repeats_and_empty(spark):
    values = [None, "", "Cegham, Kentucky", "7 Mill Court, Cegham, KY 84137", "7 Mill Court, Cegham, KY 84137", "x" * 100_000, "?!", "7 Mill Ct, Cegham"]
    assert found(spark, values) == {("7 Mill Court, Cegham, KY 84137", "7 Mill Ct, Cegham")}
    assert found(spark, []) == set()


def test_index_finds_what_comparing_all_finds(spark):
    """Candidates of the index against all pairs of the sample."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    apps = spark.read.parquet("/root/testdata/sf0.001/applications.parquet")
    known = A.parsed(apps.select(F.explode(F.array("producer_address", "importer_address")).alias("address")))
    forms = known.select("form", "number", "code", "words").distinct()
    got = {tuple(r) for r in A.containment_pairs(forms).collect()}
    import json

    all_forms = sorted(r["form"] for r in forms.collect())
    counts = {}
    for f in all_forms:
        for w in set(json.loads(f)["words"]):
            counts[w] = counts.get(w, 0) + 1
    weight = {w: math.log(1 + len(all_forms) / n) for w, n in counts.items()}
    want = {(a, b, A.relation(json.loads(a), json.loads(b), weight)) for a, b in itertools.combinations(all_forms, 2)}
    assert got == {w for w in want if w[2]}
