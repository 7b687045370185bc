import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caskwise.llm import lexicon as L


def slow_distance(a, b):
    """Unrestricted Damerau-Levenshtein by shortest paths over edits of short strings."""
    best = {a: 0}
    edge, letters = [a], sorted(set(a + b))
    while b not in best:
        nxt = []
        for s in edge:
            steps = {s[:i] + s[i + 1 :] for i in range(len(s))} | {s[:i] + c + s[i:] for i in range(len(s) + 1) for c in letters} | {s[:i] + c + s[i + 1 :] for i in range(len(s)) for c in letters} | {s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(s) - 1)}
            for t in steps:
                if t not in best:
                    best[t] = best[s] + 1
                    nxt.append(t)
        edge = nxt
    return best[b]


def test_distance_against_brute_force():
    random.seed(2)
    for _ in range(150):
        a, b = ("".join(random.choices("abc", k=random.randrange(5))) for _ in "xx")
        assert L.distance(a, b) == slow_distance(a, b), (a, b)
    assert L.distance("ca", "abc") == 2


@settings(max_examples=150, deadline=None)
@given(*[st.text("abcd", max_size=7)] * 3)
def test_distance_is_a_metric(a, b, c):
    assert L.distance(a, b) == L.distance(b, a)
    assert (L.distance(a, b) == 0) == (a == b)
    assert L.distance(a, c) <= L.distance(a, b) + L.distance(b, c)


def test_tree_returns_every_entry_within():
    random.seed(3)
    words = ["".join(random.choices("abcd", k=random.randrange(1, 7))) for _ in range(120)]
    tree = L.BKTree([(w, i) for i, w in enumerate(words)])
    for q in words[:30] + ["", "zzz"]:
        for t in (0, 1, 2):
            assert tree.within(q, t) == sorted((L.distance(q, w), i) for i, w in enumerate(words) if L.distance(q, w) <= t)
    assert L.BKTree([]).within("x", 3) == []


REFERENCE = [(100, "whiskey", "whisky"), (107, "bourbon whiskey", "bourbon"), (408, "rose wine", "rosé|blush wine"), (590, "stout", None), (597, "imperial stout", None), (212, "gin", None), (220, "barrel aged gin", None)]


@pytest.mark.parametrize(("typed", "want"), [
    ("Whitskey", 100), ("WHSKY AGED 6 YEARS", 100), ("12 year old Whisky finished in sherry casks", 100), ("Bourb. Wsky", 107), ("Whiskey (Bourbon) Gift Pack", 107), ("Stout, Imp.", 597), ("Rosé", 408), ("Small Batch Wine, Rose", 408),
    ("563 - gin no. 9", 212), ("barrel proof gin", 212), ("Barrel Aged Gin Aged 6 Years", 220), ("iced tea", 0), ("GIFT SET", 0), ("?", 0), ("cask strength energy drink", 0), ("x " * 30_000, 0),
])
def test_mapping(spark, typed, want):
    ref = spark.createDataFrame(REFERENCE, "class_id bigint, class_name string, aliases string")
    df = spark.createDataFrame([(1, typed)], "row_id bigint, class_type string")
    assert [tuple(r) for r in L.mapped_classes(spark, {"t": df}, ref).collect()] == [("t", 1, want)]


def test_edge_cases(spark, rows):
    ref = spark.createDataFrame(REFERENCE, "class_id bigint, class_name string, aliases string")
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "stout", 5), (4, "Stout", 5), (4, "Stout", 5), (None, "Gin", 5)], "row_id bigint, class_type string, class_id int")
    got = rows(L.mapped_classes(spark, {"a": df, "b": df.limit(0)}, ref))
    assert got == sorted([("a", 4, 590), ("a", 4, 590), ("a", None, 212)], key=repr)
    assert rows(L.mapped_classes(spark, {"a": df.where("row_id = 4")}, ref.limit(0))) == [("a", 4, 0), ("a", 4, 0)]


def test_shards_find_the_same(spark, rows):
    random.seed(5)
    entries = ["".join(p) for p in itertools.product("abc", repeat=5)]
    e = spark.createDataFrame([(w, i) for i, w in enumerate(entries)], "text string, entry bigint")
    p = spark.createDataFrame([("".join(random.choices("abcd", k=5)),) for _ in range(60)] + [(None,)], "phrase string")
    assert rows(L.nearest_entries(spark, p, e)) == rows(L.nearest_entries(spark, p, e, shard_entries=50, block_values=10))
