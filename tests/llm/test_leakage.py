import random

import pytest

from caskwise.llm import leakage as K

ITEM = "The memo by Wonlow says Floskborough should retire the mash kettle before the harvest, keep 7973 crates of smoked malt, and drop candied lime from every card. Its annex lists pine resin, fresh hay and 4523 as codes that Hesswick assigned to soft wheat in North Follcreek."
W = ITEM.split()


@pytest.mark.parametrize(("text", "want"), [
    (ITEM, True), (ITEM.upper(), True), ("x y. " + " ".join(W[5:20]) + " and more", True), (" ".join(W[5:13]), False), (" ".join(W[5:18]), False),
    (" ".join([*W[5:12], "changed", *W[13:24]]), True), (" ".join([*W[5:10], "a", W[10], "b", *W[12:15], "c", *W[16:20]]), False), (" ".join(W[5:12]) + " also " + " ".join(W[12:22]), True),
    ("<p>" + "\n> ".join(W[5:25]) + "</p>", True), ("-\n".join(["The memo by Won", "low says Flosk", "borough should retire the ma", "sh kettle before the harvest keep 7973 crates"]), True),
    (" ".join(W[5:24]).replace("kettle", "ket\ntle").replace("crates", "cra\ntes"), True), (" ".join(reversed(W)), False), ("", False), ("word " * 50_000 + " ".join(W[3:30]), True),
    (" ".join(W[0:12]) + " " + "pad " * 30 + " ".join(W[12:24]), False),
])
def test_passages(text, want):
    assert K.holds_passage(text, ITEM) is want


def test_operator(spark, rows):
    other = "Case 2566 concerns Nankin, who swapped the open vat for a clay jar in the dry months and told Lake Brigcrest nothing about peated malt at all."
    docs = [(1, "a b c " + ITEM, "en"), (2, "nothing here", "en"), (3, None, "en"), (4, "", None), (5, "a b c " + ITEM, "en"), (5, "a b c " + ITEM, "en"), (6, other + "\n" + " ".join(W[10:30]), "en"), (None, ITEM, "en"), (7, " ".join(W[:9]), "en")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(10, "x", ITEM), (20, "x", other), (30, "x", None), (40, "x", "too short"), (None, "x", ITEM)], "item_id bigint, kind string, text string")
    assert rows(K.leaked_items(d, i)) == [(1, 10), (5, 10), (6, 10), (6, 20)]
    assert K.leaked_items(d.limit(0), i).count() == 0
    assert K.leaked_items(d, i.limit(0)).count() == 0


def test_long_tags_and_columns(spark, rows):
    """A tag of 300 characters within a passage; columns so narrow that a shingle runs over several breaks of both kinds."""
    tag = '<a href="https://example.test/' + "x" * 300 + '">'
    columns = "The memo by Won-\nlow says\nFlosk-\nborough\nshould re-\ntire the\nmash ket-\ntle before\nthe har-\nvest, keep\n7973 cra-\ntes of\nsmoked malt,"
    d = spark.createDataFrame([(1, " ".join(W[:9]) + f" {tag}" + " ".join(W[9:20]) + "</a>"), (2, columns)], "doc_id bigint, text string")
    assert rows(K.leaked_items(d, spark.createDataFrame([(10, ITEM)], "item_id bigint, text string"))) == [(1, 10), (2, 10)]


def test_join_loses_nothing(spark):
    """Documents with pieces of items, edited within the allowance, against verifying all pairs."""
    random.seed(6)
    vocabulary = [f"w{k}" for k in range(120)]
    items = [(k, " ".join(random.choices(vocabulary, k=45))) for k in range(12)]
    docs = []
    for n in range(150):
        words = random.choices(vocabulary, k=40)
        source = items[n % 12][1].split()
        start, length = random.randrange(20), random.randrange(12, 25)
        piece = source[start : start + length]
        for _ in range(random.randrange(0, length // 8 + 1)):
            at = random.randrange(len(piece))
            piece[at : at + 1] = random.choice([[], ["zzz"], [piece[at], "yyy"]])
        docs.append((n, " ".join(words[:20] + piece + words[20:])))
    want = {(n, k) for n, t in docs for k, i in items if K.holds_passage(t, i)}
    got = {tuple(r) for r in K.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == want
    assert 40 < len(want) < 150


def test_join_loses_nothing_in_narrow_lines(spark):
    """Pieces with a changed word, wrapped in narrow lines that part some words and not others, against verifying all pairs."""
    random.seed(5)
    vocabulary = ["".join(random.choices("aeilnorst", k=random.randrange(4, 10))) for _ in range(300)]
    items = [(k, " ".join(random.choices(vocabulary, k=40))) for k in range(10)]
    docs = []
    for n in range(80):
        start, width = random.randrange(20), random.choice((14, 18, 22))
        piece = items[n % 10][1].split()[start : start + 15]
        piece[random.randrange(15)] = "changed"
        lines = [""]
        for w in piece:
            if len(lines[-1]) + len(w) < width:
                lines[-1] += w + " "
            elif random.random() < 0.5:
                lines[-1] += w[:2] + "-"
                lines.append(w[2:] + " ")
            else:
                lines.append(w + " ")
        docs.append((n, "\n".join(lines)))
    want = {(n, k) for n, t in docs for k, i in items if K.holds_passage(t, i)}
    got = {tuple(r) for r in K.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(want) > 40
    assert got == want
