from decimal import Decimal

import pytest

from caskwise.functions.chars import consistent
from caskwise.operators.units import Grammar, Unit, dims, half_up, number, stated_quantities

UNITS = [("millilitre", "volume", 1.0), ("centilitre", "volume", 10.0), ("decilitre", "volume", 100.0), ("litre", "volume", 1000.0), ("us fluid ounce", "volume", 29.5735), ("us pint", "volume", 473.176), ("us quart", "volume", 946.352), ("us gallon", "volume", 3785.408), ("percent by volume", "strength", 1.0), ("proof", "strength", 0.5), ("degree gay-lussac", "strength", 1.0), ("percent by weight", "strength", 1.25)]
G = Grammar(UNITS)


@pytest.mark.parametrize(("text", "ml"), [
    ("750 mL", [750]), ("0,75 L", [750]), (".75 Litre", [750]), ("75cl", [750]), ("7.5 dL", [750]), ("25.4 fl oz", [751]), ("1 PINT 9.4 FL OZ", [751]), ("1 pint, 16 FL OZ", [946]),
    ("25.4 FL OZ / 750 mL", [750]), ("750 ML (25.4 fl oz)", [750]), ("6 x 750 mL", [750]), ("4-pack 330 ml", [330]), ("750 mL\n1.5 L; 12 fl oz", [750, 1500, 355]),
    ("seven hundred fifty ml", [750]), ("one pint", [473]), ("1/2 gal", [1893]), ("750", []), ("", []), (None, []), ("on file", []), ("serve at 8 degrees", []), ("LOT 2011 / 750 mL", [750]),
    ("aged 12 years", []), ("７５０　ｍＬ", [750]), ("7​50 mL", [750]), ("750 МL", [750]),
])
def test_volumes(text, ml):
    assert [half_up(x) for x in G.volumes(text)] == ml


@pytest.mark.parametrize(("text", "percent"), [
    ("40%", 4000), ("ALC. 43,3% BY VOL.", 4330), ("80 proof", 4000), ("PROOF: 86", 4300), ("Est. 1987 PROOF: 86", 4300), ("90 PROOF - 45% ALC/VOL", 4500), ("6.6% ABW", 825), ("5.2% alc. by weight", 650),
    ("14,1 GL", 1410), ("12.5° GL", 1250), ("6.4 degrees Gay-Lussac", 640), ("forty-three percent by volume", 4300), ("AGED 12 YEARS, 40%", 4000), ("BATCH 31 / 40° G.L.", 4000), ("43% no. 7", 4300),
    ("12.7", None), ("", None), (None, None), ("8 degrees", None), ("cask 204", None),
])
def test_strength(text, percent):
    got = G.strength(text)
    assert (None if got is None else half_up(got * 100)) == percent


def test_units_are_vectors_with_scale_and_offset():
    kelvin = Unit("kelvin", Decimal(1), dims(temperature=1), Decimal("-273.15"))
    assert kelvin.convert(Decimal(300)) == Decimal("26.85")
    gram, millilitre = Unit("gram", Decimal(1), dims(mass=1)), Unit("ml", Decimal(1), dims(length=3))
    assert (gram / millilitre).dims == dims(mass=1, length=-3)


@pytest.mark.parametrize(("text", "value"), [("1 1/2", "1.5"), ("two hundred and five", "205"), ("three thousand", "3000"), ("twelve point five", "12.5"), ("0,5", "0.5")])
def test_numbers(text, value):
    assert number(text) == Decimal(value)


def test_stated_quantities(spark, rows):
    apps = spark.createDataFrame([(1, "750 mL; 1 L", "40%", "x"), (2, None, "", "x"), (3, "750", "80 proof", "x"), (1, "750 mL; 1 L", "40%", "x"), (4, "x " * 50_000 + "750 mL", None, "x")], "row_id bigint, net_contents string, alcohol_content string, amount string")
    results = spark.createDataFrame([(7, "net_contents", "LOT 1 / 75 cl"), (8, "brand_name", "12 ml"), (9, None, "1 ml"), (None, "alcohol_content", None)], "result_id bigint, field_name string, extracted_value string")
    units = spark.createDataFrame(UNITS, "unit_name string, quantity_kind string, factor double")
    a = "applications"
    want = [(a, 1, "alcohol_content", 1, 4000), (a, 1, "net_contents", 1, 750), (a, 1, "net_contents", 2, 1000)] * 2 + [(a, 3, "alcohol_content", 1, 4000), (a, 4, "net_contents", 1, 750), ("comparison_results", 7, "net_contents", 1, 750)]
    assert rows(stated_quantities(apps, results, units)) == sorted(want, key=repr)
    assert stated_quantities(apps.limit(0), results.limit(0), units).count() == 0
    assert stated_quantities(apps, results, units.limit(0)).count() == 0


def test_units_without_spellings(spark, rows):
    """A unit that only the table knows is read by its name; one of an unknown kind is refused."""
    apps = spark.createDataFrame([(1, "2 hectolitres", None), (2, "1.5 hectoliter; 75 cl", None), (3, "3 us barrels", None)], "row_id bigint, net_contents string, alcohol_content string")
    none = spark.createDataFrame([], "result_id bigint, field_name string, extracted_value string")
    more = [*UNITS, ("hectolitre", "volume", 100000.0), ("us barrel", "volume", 119240.0)]
    units = spark.createDataFrame(more, "unit_name string, quantity_kind string, factor double")
    got = rows(stated_quantities(apps, none, units).select("row_id", "item_no", "amount"))
    assert got == [(1, 1, 200000), (2, 1, 150000), (2, 2, 750), (3, 1, 357720)]
    with pytest.raises(ValueError, match="unknown kind"):
        Grammar([("ell", "length", 1.0)])


def test_consistent_form():
    assert consistent("Ｏｌｄ　Tom") == "Old Tom"
    assert consistent("Cuvée ﬁne") == "Cuvée fine"
    assert consistent("Wһiѕkу Коньяк") == "Whisky Коньяк"
    assert consistent("𝐎𝐥𝐝 Ꮃhisky ᎣᎣ") == "Old Whisky ᎣᎣ"
    assert consistent("a​b­c\n6° ß ® ’") == "abc\n6° ß ® ’"
    assert consistent(None) is None
    assert consistent("") == ""
