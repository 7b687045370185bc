"""Keyword-stuffed and link-list pages (problem 8).

List density: links and tags, stretches of words that keep to a small vocabulary as sentences never
do, and long runs of short items between marks of one kind are cut out of every page. Phrases of these stretches are
exploded and their distinct hosts counted. A link or tag counts against a page by itself; a stretch of
small vocabulary as far as its phrases stand on other hosts or come over and over on the page; a run of items without repeats only
as far as its items stand on other hosts. Pages of which more than half is made so are reported.

Where the documents name no host, a page's text stands for it: copies of one page are one host.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caskwise.session import cut

#: Words in a window, share of different words up to which it is a list, words of which one is judged at all.
WINDOW, VARIED, LEAST = 40, 0.70, 12
#: Items in a run and words in an item of a list.
ITEMS, ITEM_WORDS = 12, 3
#: Hosts, and times on one page, from which on a phrase is replicated; share of the characters beyond which a page is spam.
HOSTS, REPEATS, SHARE = 2, 3, 0.5

_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|<a\s[^<>]*>[^<]*</a\s*>|(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"#\w[\w\-]*|\btags?:\s?\w[\w\-]*", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
MARKS = ",;|/•·"
_MARK = re.compile(rf"\s*([{MARKS}])\s*")
#: Characters that belong to the list they stand in.
_BETWEEN = re.compile(r"[^\w]*")


def _varied(words: list[str]) -> list[bool]:
    """For each word whether it stands in a window of few different words."""
    k = len(words)
    dense = [False] * k
    if k < LEAST:
        return dense
    width = min(WINDOW, k)
    limit, count = VARIED * width, Counter(words[:width])
    half = width // 2
    for i in range(k - width + 1):
        if i:
            gone = words[i - 1]
            count[gone] -= 1
            if not count[gone]:
                del count[gone]
            count[words[i + width - 1]] += 1
        if len(count) <= limit:
            first = 0 if i == 0 else i + half - 3
            last = k if i == k - width else i + half + 3
            dense[first:last] = [True] * (min(last, k) - first)
    return dense


def _item_runs(text: str, found: list[re.Match[str]]) -> list[list[tuple[int, int]]]:
    """Runs of at least ITEMS items of up to ITEM_WORDS words with one and the same mark between them, each item as first and last word."""
    if max(map(text.count, MARKS)) < ITEMS - 1:
        return []
    runs: list[list[tuple[int, int]]] = []
    run: list[tuple[int, int]] = []
    kind, first = "", 0
    for k in range(len(found)):
        gap = text[found[k].end() : found[k + 1].start()] if k + 1 < len(found) else "\n"
        if gap and not gap.strip() and "\n" not in gap:
            continue
        mark = _MARK.fullmatch(gap)
        fits = k - first < ITEM_WORDS
        if fits and (not run or kind):
            run.append((first, k))
        if not fits or not mark or (kind and mark.group(1) != kind):
            runs.append(run)
            run, kind = [], ""
        kind = mark.group(1) if mark else ""
        first = k + 1
    runs.append(run)
    return [r for r in runs if len(r) >= ITEMS]


def evidence(text: str) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Characters of a page, characters of its links and tags, and (phrase, times, characters) of its lists, times 0 for items that aren't repeated words."""
    spans = sorted([m.span() for m in _LINK.finditer(text)] + [m.span() for m in _TAG.finditer(text)])
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    links = 0
    for i, (a, b) in enumerate(merged):
        nxt = merged[i + 1][0] if i + 1 < len(merged) else len(text)
        m = _BETWEEN.match(text, b, nxt)
        links += b - a + (m.end() - b if m and m.end() == nxt else 0)
    found, at = [], 0
    for m in _WORD.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        if at == len(merged) or m.start() < merged[at][0]:
            found.append(m)
    dense = _varied([m.group().lower() for m in found])
    phrases: dict[str, list[int]] = {}
    for i, m in enumerate(found):
        if dense[i]:
            follows = i + 1 < len(found) and dense[i + 1]
            nxt = found[i + 1] if follows else None
            gap = _BETWEEN.fullmatch(text, m.end(), nxt.start()) if nxt else None
            phrase = m.group().lower() + (" " + nxt.group().lower() if nxt else "")
            entry = phrases.setdefault(phrase, [0, 0])
            entry[0] += 1
            entry[1] += (nxt.start() if gap else m.end()) - m.start()
    repeats = Counter()
    for p, (n, _) in phrases.items():
        for w in p.split(" "):
            repeats[w] += n
    listed = {p: (max(n, min(repeats[w] // 2 for w in p.split(" "))), c) for p, (n, c) in phrases.items()}
    for run in _item_runs(text, found):
        for a, b in run:
            if not any(dense[a : b + 1]):
                item = " ".join(m.group().lower() for m in found[a : b + 1])
                times, chars = listed.get(item, (0, 0))
                end = found[b + 1].start() if (a, b) != run[-1] else found[b].end()
                listed[item] = (times, chars + end - found[a].start())
    return len(text), links, [(p, n, c) for p, (n, c) in listed.items()]


EVIDENCE = T.StructType([
    T.StructField("chars", T.LongType()), T.StructField("links", T.LongType()),
    T.StructField("phrases", T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("times", T.LongType()), T.StructField("chars", T.LongType())]))),
])


@F.pandas_udf(EVIDENCE)
def evidence_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evidence(t) for t in texts], columns=EVIDENCE.names)


def spam_pages(documents: DataFrame, host: str | None = None) -> DataFrame:
    """(doc_id,) of pages that are mostly repeated keywords, links or tags; `host` is the column that names a page's host, if there is one.

    Null and empty texts are none; a null host is the text itself. Every copy of a page is reported under its own id, a repeated row of
    one id once. Whole texts are read; an empty table gives an empty table.
    """
    text = F.md5("text")
    pages = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("page"), (F.coalesce(F.col(host).cast("string"), text) if host else text).alias("host"), "text")
    seen = pages.select("doc_id", "page", "host", evidence_udf("text").alias("e")).select("doc_id", "page", "host", "e.*")
    listed = cut(seen.where("links > 0 or size(phrases) > 0"))
    # a page can only be reported if its lists and links together may pass the share
    most = F.col("links") + F.aggregate("phrases", F.lit(0).cast("bigint"), lambda s, p: s + p["chars"])
    phrases = listed.select("page", "host", F.explode("phrases").alias("p")).select("page", "host", "p.*")
    hosts = phrases.groupBy("phrase").agg(F.count_distinct("host").alias("hosts"))
    alone = listed.where(most > SHARE * F.col("chars")).dropDuplicates(["page"]).select("page", "links", F.col("chars").alias("all"), F.explode_outer("phrases").alias("p")).select("page", "links", "all", "p.*")
    counts = (F.col("hosts") >= HOSTS) | (F.col("times") >= REPEATS)
    made = alone.join(hosts, "phrase", "left").groupBy("page").agg((F.first("links") + F.sum(F.when(counts, F.col("chars")).otherwise(0))).alias("made"), F.first("all").alias("all"))
    spam = made.where(F.col("made") > SHARE * F.col("all"))
    return listed.select("doc_id", "page").join(spam, "page", "left_semi").select("doc_id").distinct()
