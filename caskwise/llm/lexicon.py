"""Free-entered values mapped to a canonical list (problem 3).

Entries of the reference list stand in BK-trees under the true Damerau-Levenshtein metric (moves of
neighbouring letters may be edited again, so the triangle inequality holds). A search returns every
entry within the threshold of a value; the winners of all shards are merged. A small list is
broadcast as one tree, a large one is cut into shards, each searched by blocks of values.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caskwise.functions.chars import consistent
from caskwise.session import cut, spread

#: Entries in one tree; a longer list is cut into shards of about this size.
SHARD_ENTRIES = 20_000
#: Values that one task searches in one shard, about.
BLOCK_VALUES = 20_000

# Words on age, size, casks, release, quality, origin or filing. '#' is a number.
QUALIFIERS = """
aged # years|aged # yrs|aged # year|aged # months|# year old|# years old|# yr old|# yr|# yrs|# years|# year|vintage #
finished in port barrels|finished in sherry casks|finished in rum casks|finished in wine casks|finished in bourbon barrels
matured in rum casks|matured in port barrels|matured in sherry casks|matured in oak casks|matured in bourbon barrels
bottled in bond|small batch|single cask|single barrel|barrel proof|cask strength|limited edition|limited release
special selection|special release|special reserve|private reserve|reserve|premium|craft|handmade|hand crafted|artisan
artisanal|certified organic|organic|kosher|unfiltered|estate|estate bottled|product of usa|product of the usa
product of united states|imported|domestic|gift pack|gift set|with label approval|label approval|no #|number #|# ml|#ml|batch #|lot #
""".replace("\n", "|").strip("|").split("|")  # fmt: skip

# Short forms of words in class names.
SHORT = {
    "wsky": "whisky", "whsky": "whisky", "whky": "whisky", "wky": "whisky", "vdka": "vodka", "brndy": "brandy", "brbn": "bourbon", "bourb": "bourbon",
    "str": "straight", "strt": "straight", "liqr": "liqueur", "teq": "tequila", "flav": "flavored", "flvd": "flavored", "flavoured": "flavored",
    "spkl": "sparkling", "sprk": "sparkling", "tbl": "table", "imp": "imperial", "hvst": "harvest", "blnd": "blended", "bld": "blended",
    "brl": "barrel", "bev": "beverage", "fort": "fortified", "dess": "dessert", "sgl": "single", "ind": "india", "can": "canadian", "jap": "japanese",
}


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with adjacent moves, unrestricted: a true metric."""
    if a == b:
        return 0
    start = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    far = n + m
    rows = [[far] * (m + 2), [far, *range(m + 1)]]
    seen: dict[str, int] = {}
    for i in range(1, n + 1):
        row, above, last, ch = [far, i], rows[i], 0, a[i - 1]
        for j in range(1, m + 1):
            k, other = seen.get(b[j - 1], 0), last
            if ch == b[j - 1]:
                best, last = above[j], j
            else:
                best = 1 + min(above[j], above[j + 1], row[j])
            row.append(min(best, rows[k][other] + i - k - 1 + 1 + j - other - 1))
        rows.append(row)
        seen[ch] = i
    return rows[-1][-1]


class BKTree:
    """Entries arranged by distance; a search visits only branches that the triangle inequality leaves open."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.ids: dict[str, set[int]] = {}
        for text, entry in entries:
            self.ids.setdefault(text, set()).add(entry)
        self.children: dict[str, dict[int, str]] = {t: {} for t in self.ids}
        texts = iter(self.ids)
        self.root = next(texts, None)
        for text in texts:
            node = self.root
            while (d := distance(text, node)) in self.children[node]:
                node = self.children[node][d]
            self.children[node][d] = text

    def within(self, text: str, threshold: int) -> list[tuple[int, int]]:
        """(distance, entry id) of every entry within the threshold, nearest first."""
        return sorted((d, entry) for d, _, entry in self.ranked(text, threshold))

    def ranked(self, text: str, threshold: int) -> list[tuple[int, bool, int]]:
        """(distance, whether the first letter differs, entry id) of every entry within the threshold, in this order."""
        found, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            d = distance(text, node)
            if d <= threshold:
                found += [(d, node[:1] != text[:1], entry) for entry in self.ids[node]]
            stack += [child for edge, child in self.children[node].items() if d - threshold <= edge <= d + threshold]
        return sorted(found)


def allowed(text: str) -> int:
    """Edits that a typed text of this length may hold."""
    return 0 if len(text) < 3 else 1 if len(text) < 7 else 2 if len(text) < 16 else 3


@lru_cache(maxsize=100_000)
def _near(word: str, typed: str) -> bool:
    if word == typed:
        return True
    return len(word) > 3 and abs(len(word) - len(typed)) <= 1 and distance(word, typed) <= 1


_PHRASES = sorted((q.split() for q in QUALIFIERS), key=len, reverse=True)
_LEADING: dict[str, list[list[str]]] = {}


def _fits(phrase: list[str], words: list[str]) -> bool:
    return len(phrase) <= len(words) and all(w.isdigit() if p == "#" else _near(p, w) for p, w in zip(phrase, words, strict=False))


def plain_words(text: str) -> list[str]:
    text = unicodedata.normalize("NFD", (consistent(text) or "").lower().replace("ß", "ss"))
    text = "".join(ch for ch in text if not unicodedata.combining(ch))
    return re.findall(r"[^\W_]+", text)


def phrase_of(text: str) -> str:
    """The class phrase of a typed value: qualifiers cut off, short forms written out, order restored."""
    text = (consistent(text) or "").strip()
    text = re.sub(r"^\s*\d+\s*[-:]\s+", "", text)

    def clean(part: str) -> list[str]:
        words = plain_words(part)
        trimmed = True
        while words and trimmed:
            trimmed = False
            for p in _PHRASES:
                if _fits(p, words):
                    own = p[-1] == "old" and words[len(p) : len(p) + 1] == ["tom"]  # 'old' opens the name itself
                    words, trimmed = words[len(p) - own :], True
                elif len(p) <= len(words) and _fits(p, words[len(words) - len(p) :]):
                    words, trimmed = words[: len(words) - len(p)], True
            if words and len(words) > 1 and words[-1].isdigit():
                words, trimmed = words[:-1], True
        return words

    def spelled(words: list[str]) -> list[str]:
        out = [SHORT.get(w, w) for w in words]
        return ["liquor" if "malt" in out else "liqueur" if w == "liq" else w for w in out] if "liq" in out else out

    bracket = re.search(r"\(([^)]*)\)", text)
    if bracket:
        inside, before, after = clean(bracket.group(1)), text[: bracket.start()], text[bracket.end() :]
        if inside:
            return " ".join(spelled(inside + clean(before) + [w for w in clean(after) if not w.isdigit()]))
        text = f"{before} {after}"
    head, comma, tail = text.partition(",")
    if comma:
        return " ".join(spelled(clean(" ".join(clean(tail) + clean(head)))))
    return " ".join(spelled(clean(text)))


@F.pandas_udf(T.StringType())
def phrase_udf(values: pd.Series) -> pd.Series:
    cached = lru_cache(maxsize=50_000)(phrase_of)
    return values.map(cached, na_action="ignore")


def spellings(name: str) -> set[str]:
    words = " ".join(plain_words(name))
    return {words, words.replace("whiskey", "whisky"), re.sub(r"\bwhisky\b", "whiskey", words)} - {""}


def entry_spellings(reference: DataFrame, entry: str, name: str, aliases: str) -> DataFrame:
    """(text, entry): a row for every spelling of an entry's name and of its aliases, which '|' separates."""

    @F.pandas_udf("array<string>")
    def texts(names: pd.Series) -> pd.Series:
        return names.map(lambda n: sorted(spellings(n)) if n else [])

    named = reference.select(
        F.col(entry).cast("bigint").alias("entry"), F.explode(F.split(F.concat_ws("|", F.col(name), F.col(aliases)), r"\|")).alias("name")
    ).where("entry is not null")
    return named.select("entry", F.explode(texts("name")).alias("text")).distinct()


def nearest_entries(spark: SparkSession, phrases: DataFrame, entries: DataFrame, shard_entries: int = SHARD_ENTRIES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(phrase, entry, edits) of the nearest entry for each distinct phrase that has one within `allowed`.

    `phrases` has a column `phrase`, `entries` has `text` and `entry`. Among equally near entries one
    with the phrase's first letter wins, then the smallest id. Null phrases and phrases without a near entry give no row; an empty list or an empty
    table of phrases gives an empty result.
    """
    distinct = phrases.select("phrase").where("phrase is not null").distinct()
    size = entries.count()
    schema = "phrase string, entry bigint, edits int, other boolean"
    if size <= shard_entries:
        tree = spark.sparkContext.broadcast([(r["text"], r["entry"]) for r in entries.select("text", "entry").collect()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = BKTree(tree.value)
            for batch in batches:
                yield _winners(index, batch["phrase"])

        found = spread(distinct).mapInPandas(search, schema)
    else:
        shards = -(-size // shard_entries)
        blocks = max(1, -(-distinct.count() // block_values))
        left = distinct.select("phrase", F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        # every tree is built once, in the order of the table, and sent to the blocks of values as it is
        trees = entries.select("text", "entry", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInPandas(_planted, "shard int, tree binary")
        right = trees.select("shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

        def cell(values: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            index = pickle.loads(part["tree"].iloc[0]) if len(part) else BKTree([])
            return _winners(index, values["phrase"])

        found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(cell, schema)
    return found.groupBy("phrase").agg(F.min(F.struct("edits", "other", "entry")).alias("best")).select("phrase", "best.entry", "best.edits")


def _planted(part: pd.DataFrame) -> pd.DataFrame:
    tree = BKTree(list(zip(part["text"], part["entry"], strict=True)))
    return pd.DataFrame({"shard": part["shard"].iloc[:1], "tree": [pickle.dumps(tree)]})


def _winners(index: BKTree, phrases: pd.Series) -> pd.DataFrame:
    rows = []
    for phrase in phrases:
        found = index.ranked(phrase, allowed(phrase))
        if found:
            edits, other, entry = found[0]
            rows.append((phrase, entry, edits, other))
    return pd.DataFrame(rows, columns=["phrase", "entry", "edits", "other"]).astype({"entry": "int64", "edits": "int32", "other": "bool"})


def mapped_classes(spark: SparkSession, sources: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """(src, row_id, class_id) for every typed class that is not letter for letter a name of the list.

    `class_id` is the entry named by the value, 0 if it names none. Null and empty values are no cases;
    repeated rows are reported under each id; an empty reference list gives 0 throughout.
    """
    rows = None
    for src, df in sources.items():
        part = df.select(F.lit(src).alias("src"), F.col("row_id").cast("bigint").alias("row_id"), F.col("class_type").alias("typed"))
        rows = part if rows is None else rows.unionByName(part)
    names = reference.select(F.col("class_name").alias("typed")).where("typed is not null").distinct()
    rows = rows.where("typed is not null and typed <> ''").join(names, "typed", "left_anti")
    typed = cut(spread(rows.select("typed").distinct()).withColumn("phrase", phrase_udf("typed")))
    nearest = nearest_entries(spark, typed, entry_spellings(reference, "class_id", "class_name", "aliases"))
    classes = typed.join(nearest, "phrase", "left").select("typed", F.coalesce("entry", F.lit(0)).cast("bigint").alias("class_id"))
    return rows.join(classes, "typed").select("src", "row_id", "class_id")
