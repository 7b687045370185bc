import pytest
from pyspark.sql import functions as F

from caskwise.llm import spam as S

PROSE = "The yeast was bought in a small town and kept alive on malt. Our second bottle, filled last autumn, had no honey at all. A new copper pot was ordered before the holidays, and nobody would confirm the price. With water the fruit fades and something like warm bread comes forward. Glass is scarce again, so the cellar manager has begun to ration it."
SPAM = {
    "commas": ", ".join(f"{a} {b}" for a in "cheap best buy free top order".split() for b in "gin rum vodka".split() * 2),
    "blanks": "cheap gin buy rum best vodka cheap rum " * 12,
    "links": "\n".join(f"http://host{k}.example/gin-rum?id={k}" for k in range(12)),
    "markdown": "\n".join(f"[buy gin](https://h{k}.test/x)" for k in range(12)),
    "html": " ".join(f'<a href="http://h{k}.test">cheap rum</a>' for k in range(12)),
    "hashtags": " ".join(f"#gin{k}" for k in range(40)),
    "tags": " ".join(f"tag:buy_rum_{k}" for k in range(40)),
    "sentences": "Cheap gin is the best gin you want when you want gin. For cheap gin think gin. Buy gin and cheap gin with gin. " * 4,
    "products": " / ".join(f"{n} {p} {s}" for n in "Stonby Tenwick Casslow".split() for p in "gin rum bottle flask".split() for s in "6pk 1L sale".split()),
}
FINE = [PROSE, PROSE + "\nSee also:\n- http://a.example/x\n- http://b.example/y", PROSE + " Ingredients: water, barley malt, hops, yeast.", PROSE + "\nDrinks: gin, rum, sherry, mezcal, cider, stout, tonic.", "OLD ANVIL\nRye Whiskey\n40%\n750 mL", "short", "", None]


@pytest.mark.parametrize("kind", sorted(SPAM))
def test_kinds(spark, kind):
    df = spark.createDataFrame([(1, SPAM[kind]), (2, "A sentence about casks stands before it. " + SPAM[kind]), (3, PROSE * 9 + SPAM[kind])], "doc_id bigint, text string")
    got = {r["doc_id"] for r in S.spam_pages(df).collect()}
    assert {1} <= got <= {1, 2}


def test_others(spark, rows):
    data = [(k, t, "clash") for k, t in enumerate(FINE)] + [(50, SPAM["commas"], "x"), (50, SPAM["commas"], "x"), (51, SPAM["commas"], None), (None, SPAM["commas"], "x"), (52, SPAM["links"] * 300, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, host string")
    assert rows(S.spam_pages(df)) == [(50,), (51,), (52,)]
    assert S.spam_pages(df.limit(0)).count() == 0


ITEMS = [f"{a} {b}" for a, b in zip("amber oaken winter copper river velvet harbor crimson meadow silver autumn golden marble linen".split(), "flask decanter tumbler stopper funnel goblet coaster barrel corkscrew pitcher shaker strainer bucket cradle".split(), strict=True)]


def test_hosts_decide(spark, rows, monkeypatch):
    """A list of items without any repeats is spam if the items stand on another host, and none if they don't."""
    page, other, lone = ", ".join(ITEMS), " | ".join(reversed(ITEMS)), ", ".join(f"{x[::-1]}" for x in ITEMS)
    df = spark.createDataFrame([(1, page, "a.test"), (2, other, "b.test"), (3, lone, "c.test"), (4, SPAM["commas"], "d.test")], "doc_id bigint, text string, site string")
    assert rows(S.spam_pages(df)) == [(1,), (2,), (4,)]
    assert rows(S.spam_pages(df, "site")) == [(1,), (2,), (4,)]
    one = df.withColumn("site", F.lit("one.test"))
    assert rows(S.spam_pages(one, "site")) == [(4,)]
    monkeypatch.setattr(S, "HOSTS", 10**9)
    assert rows(S.spam_pages(df)) == [(4,)]


def test_nothing_outside_imports_this_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for p in (root / "caskwise").rglob("*.py"):
        if "llm" not in p.parts:
            assert "caskwise.llm" not in p.read_text(), p
