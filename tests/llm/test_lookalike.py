from caskwise.llm import lookalike as L

ODD = ["Wһisky", "Ｏｌｄ", "a b", "zero​width", "Café", "oﬃce", "soft­hyphen"]
FINE = ["Café", "Коньяк", "Straße", "40° ®", "‘x’", "line\nbreak", "MiXeD", "焼酎", "", None, "x" * 100_000]


def test_inconsistent(spark, rows):
    data = [(i, v, None, "clash") for i, v in enumerate(ODD + FINE)] + [(100, None, "Wһisky", "clash"), (100, None, "Wһisky", "clash")]
    df = spark.createDataFrame(data, "result_id bigint, declared_value string, extracted_value string, value string")
    assert rows(L.inconsistent(spark, df)) == sorted([(i, "declared") for i in range(len(ODD))] + [(100, "extracted")] * 2, key=repr)
    assert L.inconsistent(spark, df.limit(0)).count() == 0


def test_class_decides(spark):
    """A format character that the look-alike map leaves alone is nothing to the collation: the shorter member stands for the class, in which case and accents count."""
    odd = "Caf\u00e9 O\U0001bca0ld"
    assert L.consistent(odd) == odd
    df = spark.createDataFrame([(odd,), ("Caf\u00e9 Old",), ("caf\u00e9 old",), ("Cafe\u0300 Old",)], "value string")
    got = {r["value"]: r["canonical"] for r in L.canonical_values(spark, df).collect()}
    assert got == {odd: "Caf\u00e9 Old", "Caf\u00e9 Old": "Caf\u00e9 Old", "caf\u00e9 old": "caf\u00e9 old", "Cafe\u0300 Old": "Caf\u00e8 Old"}


def test_equal_looking_values_compare_equal(spark):
    df = spark.createDataFrame([(1, "Wһisky", "a"), (2, "Whisky", "b"), (3, "Ｗｈｉｓｋｙ", None), (4, "whisky", None), (5, None, None), (6, "Café", "x"), (7, "Café", "y")], "id int, v string, canonical string")
    got = {r["id"]: r["form"] for r in L.with_consistent(spark, df, "v", "form").collect()}
    assert got == {1: "Whisky", 2: "Whisky", 3: "Whisky", 4: "whisky", 5: None, 6: "Caf\u00e9", 7: "Caf\u00e9"}
